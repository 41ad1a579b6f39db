"""Validators and reports: rules as violation rows, lines and JSON made by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import PHASE_VERBS, token_estimate
from tidemark.operators.fusion import CONFIDENCE, EFFECTS, SOURCES

KEBAB = "^[a-z0-9]+(-[a-z0-9]+)*$"
GATES = ("publish", "spend", "irreversible", "legal", "privacy")
# Closed lists of an inventory and its catalogues.
REPO_CLASSES = ("library", "cli-tool", "service-app", "agent-system", "infra-config", "unknown")
STATUSES = ("draft", "reviewed", "accepted-unreviewed")
TRIGGERS = ("manual", "scheduled", "event")
CREDENTIAL_KINDS = ("apikey", "oauth", "token", "password", "other")
STANDIN_TYPES = ("reducing", "deferred", "no-op")
INPUT_KINDS = ("string", "number", "integer")
FRONT_KEYS = ("name", "description", "license", "compatibility", "metadata", "allowed-tools")
TOP_ENTRIES = ("SKILL.md", "references", "scripts", "assets")
#: Budgets of an emitted package.
MOST_LINES, MOST_TOKENS, MOST_NAME, MOST_DESCRIPTION, MOST_COMPATIBILITY = 500, 5000, 64, 1024, 500


def broken(tests: dict[str, Column]) -> Column:
    """Names of the rules whose test holds; a test that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(k)) for k, t in tests.items()]))


def closed(c: str, values: tuple[str, ...]) -> Column:
    """The value isn't one of a closed list; null isn't either."""
    return ~F.col(c).isin(*values)


def validate_operations(operations: DataFrame, scope: list[str], vocabulary: DataFrame | None = None, standins: DataFrame | None = None) -> DataFrame:
    """Violations (scope, id, rule) of an inventory's operations.

    Rules on columns that ``operations`` doesn't have are left out, but for the required ones. vocabulary: capability;
    standins: stand_in.
    """
    have = set(operations.columns)
    absent = lambda c: F.col(c).isNull() if c in have else F.lit(True)
    twice = operations.groupBy(*scope, "id").count().where("count > 1").select(*scope, "id", F.lit("duplicate-id").alias("rule"))
    tests = {
        "id-form": ~F.col("id").rlike(KEBAB), "stage": closed("stage", tuple(PHASE_VERBS)), "effect": closed("effect", EFFECTS), "confidence": closed("confidence", CONFIDENCE),
        "requires-empty": F.size("requires") == 0, "gate": F.size(F.array_except("gate", F.array(*map(F.lit, GATES)))) > 0,
    }
    if "name" in have:
        tests["name-missing"] = absent("name")
    if "gate_confidence" in have:
        tests |= {"gate-confidence-missing": (F.size("gate") > 0) & absent("gate_confidence"), "gate-confidence": ~absent("gate_confidence") & F.coalesce(closed("gate_confidence", CONFIDENCE), F.lit(False))}
    if "evidence" in have:
        tests |= {
            "evidence-empty": F.size("evidence") == 0, "evidence-source": F.exists("evidence", lambda e: ~F.coalesce(e["source"].isin(*SOURCES), F.lit(False))),
            "evidence-loc": F.exists("evidence", lambda e: F.coalesce(e["loc"], F.lit("")) == ""),
        }
    if "trigger" in have:
        tests["trigger"] = ~absent("trigger") & F.coalesce(closed("trigger", TRIGGERS), F.lit(False))
    for c in ("optional", "deterministic"):
        if c in have:
            tests[f"{c}-missing"] = absent(c)
    out = operations.select(*scope, "id", F.explode(broken(tests)).alias("rule")).unionByName(twice)
    if vocabulary is not None:
        used = operations.select(*scope, "id", F.explode("requires").alias("capability"))
        out = out.unionByName(used.join(vocabulary.select("capability"), "capability", "left_anti").select(*scope, "id", F.lit("unknown-capability").alias("rule")).distinct())
    if standins is not None and "stand_in" in have:
        named = operations.where("stand_in is not null")
        out = out.unionByName(named.join(standins.select("stand_in"), "stand_in", "left_anti").select(*scope, "id", F.lit("unknown-stand-in").alias("rule")))
    return out


def validate_inventories(inventories: DataFrame) -> DataFrame:
    """Violations of the fields around the operations: repo, repo_class, inventory_status, schema_version."""
    tests = {"repo-class": closed("repo_class", REPO_CLASSES), "status": closed("inventory_status", STATUSES), "schema-version": F.col("schema_version").isNull()}
    return inventories.select("repo", F.explode(broken(tests)).alias("rule"))


def repeats(c: str) -> Column:
    return F.size(F.array_distinct(c)) < F.size(c)


def validate_profiles(profiles: DataFrame, vocabulary: DataFrame, today: Column) -> DataFrame:
    """Violations of profiles (profile, native, mcp, expiry): form, unknown capabilities, repeats, one in both channels, expired."""
    offered = profiles.select("profile", F.explode(F.array_union("native", "mcp")).alias("capability"))
    unknown = offered.join(vocabulary, "capability", "left_anti").select("profile", F.lit("unknown-capability").alias("rule")).distinct()
    tests = {
        "id-form": ~F.col("profile").rlike(KEBAB), "both-channels": F.arrays_overlap("native", "mcp"), "native-repeats": repeats("native"), "mcp-repeats": repeats("mcp"),
        "expired": F.coalesce(F.to_date("expiry") < today, F.lit(False)),
    }
    twice = profiles.groupBy("profile").count().where("count > 1").select("profile", F.lit("duplicate-id").alias("rule"))
    return profiles.select("profile", F.explode(broken(tests)).alias("rule")).unionByName(unknown).unionByName(twice)


def validate_catalogue(providers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Violations of a provider catalogue: provider, rule.

    providers: provider, packages (map of ecosystem to names), caps, effect, gates, credentials (name, kind), ambiguous, note.
    """
    named = F.coalesce("provider", F.lit(""))
    tests = {
        "id-missing": named == "", "no-packages": F.coalesce(F.size("packages") <= 0, F.lit(True)), "empty-packages": F.exists(F.map_values("packages"), lambda n: F.coalesce(F.size(n) <= 0, F.lit(True))),
        "effect": F.col("effect").isNotNull() & F.coalesce(closed("effect", EFFECTS), F.lit(False)), "gate": F.size(F.array_except("gates", F.array(*map(F.lit, GATES)))) > 0,
        "credential-name": F.exists("credentials", lambda c: F.coalesce(c["name"], F.lit("")) == ""), "credential-kind": F.exists("credentials", lambda c: ~F.coalesce(c["kind"].isin(*CREDENTIAL_KINDS), F.lit(False))),
        "ambiguous-without-note": F.coalesce("ambiguous", F.lit(False)) & (F.coalesce("note", F.lit("")) == ""),
    }
    twice = providers.where(named != "").groupBy("provider").count().where("count > 1").select("provider", F.lit("duplicate-id").alias("rule"))
    used = providers.select("provider", F.explode("caps").alias("capability"))
    unknown = used.join(vocabulary.select("capability"), "capability", "left_anti").select("provider", F.lit("unknown-capability").alias("rule")).distinct()
    return providers.select("provider", F.explode(broken(tests)).alias("rule")).unionByName(twice).unionByName(unknown)


def validate_standins(standins: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Violations of stand-ins: stand_in, rule. ``desc``, ``capability`` are checked where the table has them."""
    have = set(standins.columns)
    tests = {"fidelity": (F.col("fidelity") < 0) | (F.col("fidelity") >= 1), "type": closed("type", STANDIN_TYPES)}
    if "desc" in have:
        tests["desc-missing"] = F.coalesce("desc", F.lit("")) == ""
    out = standins.select("stand_in", F.explode(broken(tests)).alias("rule"))
    out = out.unionByName(standins.groupBy("stand_in").count().where("count > 1").select("stand_in", F.lit("duplicate-id").alias("rule")))
    if vocabulary is not None and "capability" in have:
        unknown = standins.where("capability is not null").join(vocabulary.select("capability"), "capability", "left_anti")
        out = out.unionByName(unknown.select("stand_in", F.lit("unknown-capability").alias("rule")))
    return out


def validate_execution(standins: DataFrame, shipped: DataFrame) -> DataFrame:
    """Violations of how stand-ins run: stand_in, rule.

    standins: stand_in, script, unavailable (why it can't run), tools, inputs (name, type, default as JSON); shipped: script.
    """
    runs, excused = F.coalesce("script", F.lit("")) != "", F.trim(F.coalesce("unavailable", F.lit(""))) != ""
    wrong = lambda i: ~F.coalesce(i["type"].isin(*INPUT_KINDS), F.lit(False))
    tests = {
        "neither-runs-nor-says-why": ~runs & ~excused, "runs-and-says-why-not": runs & excused, "tool-empty": runs & F.exists("tools", lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""),
        "input-type": runs & F.exists("inputs", wrong), "input-default": runs & F.exists("inputs", lambda i: ~wrong(i) & i["default"].isNotNull() & ~is_kind(i["default"], i["type"])),
    }
    missing = standins.where(runs).join(shipped.select("script"), "script", "left_anti").select("stand_in", F.lit("script-not-shipped").alias("rule"))
    return standins.select("stand_in", F.explode(broken(tests)).alias("rule")).unionByName(missing)


def is_kind(value: Column, kind: Column) -> Column:
    """A JSON value is of the kind string, number or integer; true and false are no numbers."""
    what = F.schema_of_variant(F.try_parse_json(value))
    number = what.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    whole = (what == "BIGINT") | what.rlike(r"^DECIMAL\(\d+,0\)")
    return F.coalesce(F.when(kind == "string", what == "STRING").when(kind == "number", number).when(kind == "integer", whole & ~F.contains(value, F.lit("."))).otherwise(True), F.lit(False))


def line_count(text: Column) -> Column:
    """Lines of a text; the empty one has none, a last newline opens none."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n"), 0).otherwise(1))


def validate_package(files: DataFrame, name: str, text: str) -> DataFrame:
    """Violations of a package's budgets by file: lines, tokens, name."""
    lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    tests = {"lines": lines > MOST_LINES, "tokens": token_estimate(F.col(text)) > MOST_TOKENS, "name": (F.length(name) > MOST_NAME) | ~F.col(name).rlike(KEBAB)}
    return files.select(name, F.explode(broken(tests)).alias("rule"))


def validate_packages(files: DataFrame) -> DataFrame:
    """Violations of packages (package, rel, text), each with a SKILL.md: front matter, budgets, depth of references, entries.

    Result: package, rule. Faults of the front matter come with their own names and stop the other tests of the file; of a name that
    it has twice, the last value counts. A file is tested within its row, and only three marks a package are brought together.
    """
    from tidemark.sources.catalogues import front_lines

    read = files.where("rel = 'SKILL.md'").select("package", "text", front_lines(F.col("text")).alias("front"))
    body = F.trim(F.regexp_replace("text", r"(?s)^---.*?\n[ \t]*---[ \t]*(?:\n|\z)", ""), F.lit(" \n\t\r"))
    faults, top = F.filter("front", lambda x: x["fault"].isNotNull()), F.filter("front", lambda x: x["fault"].isNull() & x["parent"].isNull())
    told = read.select("package", faults.alias("faults"), top.alias("top"), body.alias("body"))
    value = lambda k: F.coalesce(F.try_element_at(F.filter("top", lambda x: x["name"] == k), F.lit(-1))["value"], F.lit(""))
    name, lines = value("name"), line_count(F.col("body"))
    tests = {
        "name-empty": name == "", "name-form": (name != "") & ~name.rlike(KEBAB), "name-length": F.length(name) > MOST_NAME, "name-folder": (name != "") & (name != F.col("package")), "description-empty": value("description") == "",
        "description-length": F.length(value("description")) > MOST_DESCRIPTION, "compatibility-length": F.length(value("compatibility")) > MOST_COMPATIBILITY, "unknown-key": F.exists("top", lambda x: ~x["name"].isin(*FRONT_KEYS)),
        "lines": lines > MOST_LINES, "tokens": token_estimate(F.col("body")) > MOST_TOKENS,
    }
    faulty = F.transform("faults", lambda x: F.concat(F.lit("front-matter-"), x["fault"]))
    out = told.select("package", F.explode(F.when(F.size("faults") > 0, faulty).otherwise(broken(tests))).alias("rule"))
    marks = {"no-skill-file": F.col("rel") != "SKILL.md", "reference-depth": F.expr("rel like 'references/%' and size(split(rel, '/')) > 2"), "unexpected-entry": ~F.substring_index("rel", "/", 1).isin(*TOP_ENTRIES)}
    # A package has no skill file where no file is one; of the other rules, one file that breaks them is enough.
    seen = files.groupBy("package").agg(*[(F.min if k == "no-skill-file" else F.max)(F.coalesce(m, F.lit(k == "no-skill-file"))).alias(k) for k, m in marks.items()])
    return out.unionByName(seen.select("package", F.explode(F.array_compact(F.array(*[F.when(F.col(f"`{k}`"), F.lit(k)) for k in marks]))).alias("rule")))


def validate_declaration(bodies: DataFrame, key: str, text: str) -> DataFrame:
    """Bodies that don't say which profile they were made for, or what it offers: key, rule."""
    low = F.lower(text)
    says = F.contains(low, F.lit("profile"))
    offers = F.contains(low, F.lit("native")) | F.contains(low, F.lit("mcp"))
    rule = F.when(~says, "no-profile").when(~offers, "no-channels")
    return bodies.select(key, rule.alias("rule")).where("rule is not null")


def report_json(summary: DataFrame, key: list[str]) -> DataFrame:
    """A JSON document for each summary row, fields in alphabetical order."""
    return summary.select(*key, F.to_json(F.struct(*sorted(c for c in summary.columns if c not in key))).alias("report"))


def report_line() -> Column:
    """One fixed-width line of a routing report."""
    return F.concat(F.rpad("id", 24, " "), F.rpad("binding", 10, " "), F.format_string("%5.2f", "coverage"), F.lit("  "), F.concat_ws(",", "gates"))


def review_line() -> Column:
    """One line of a review list: confidence, id, requirements, gates."""
    gated = F.when(F.size("gate") > 0, F.concat(F.lit(" [gates: "), F.concat_ws(", ", "gate"), F.lit("]"))).otherwise("")
    return F.concat(F.lit("- ("), "confidence", F.lit(") `"), "id", F.lit("` needs "), F.concat_ws(", ", "requires"), gated)


#: What a reviewer does with an inventory, as the end of a review.
CONFIRM = ("Check each row against its places, most uncertain first.", "Put right stage, effect, requirements and gates where they are wrong.", "Replace `external.call` by what is really needed, or leave the operation out.", "Set the status to `reviewed`.")


def review_lines(operations: DataFrame, scope: list[str], meta: DataFrame | None = None, warnings: DataFrame | None = None, unknown: DataFrame | None = None) -> DataFrame:
    """A review of each scope as lines: where it comes from, warnings, what needs a look, a table of the operations, how to confirm.

    Operations come most uncertain first, with the sources of their ``evidence`` and their ``notes`` where they have such columns.
    meta: scope, url, sha, status, repo_class; warnings: scope, ord, warning; unknown: scope, name (dependencies outside the
    catalogue). Lines are rows (scope, section, place, line), so a long review is never gathered; order by section and place.
    """
    from pyspark.sql import Window

    from tidemark.operators.fusion import attention_order, first_places

    lines = lambda rows, section, *text: rows.select(*scope, F.lit(section).alias("section"), F.posexplode(F.array_compact(F.array(*text))).alias("place", "line"))
    counts = operations.groupBy(*scope).agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") == "low").alias("low"), F.count_if(F.size("gate") > 0).alias("gated"), F.count_if(F.col("requires") == F.array(F.lit("external.call"))).alias("open"),
    )
    say = lambda head, c, tail="": F.concat(F.lit(head), F.col(c).cast("string"), F.lit(tail))
    parts = [lines(counts, 3, say("Operations: **", "n", "**"), say("- low confidence: **", "low", "**"), say("- with gates: **", "gated", "**"), say("- nothing known but `external.call`: **", "open", "**"))]
    if meta is not None:
        code = lambda head, c: F.concat(F.lit(head), F.lit("`"), F.col(c), F.lit("`"))
        parts.append(lines(meta, 1, F.coalesce(code("Source: ", "url"), F.lit("Source: unknown")), code("Version: ", "sha"), code("Class: ", "repo_class"), code("Status: ", "status")))
    if warnings is not None:
        parts.append(warnings.select(*scope, F.lit(2).alias("section"), F.col("ord").cast("int").alias("place"), F.concat(F.lit("- "), "warning").alias("line")))
    if unknown is not None:
        told = first_places(unknown, scope, "name", 8)
        parts.append(told.select(*scope, F.lit(4).alias("section"), F.lit(0).alias("place"), F.concat(F.lit("- dependencies outside the catalogue: "), "locations").alias("line")))
    sources = F.array_join(F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["source"]))), ", ") if "evidence" in operations.columns else None
    cells = [F.concat(F.lit("`"), "id", F.lit("`")), "stage", "effect", F.array_join("requires", ", "), F.when(F.size("gate") > 0, F.array_join("gate", ", ")).otherwise("-"), "confidence", *([sources] if sources is not None else [])]
    names = ["operation", "stage", "effect", "requires", "gates", "confidence", *(["evidence"] if sources is not None else [])]
    parts.append(lines(counts, 5, F.lit(f"| {' | '.join(names)} |"), F.lit("|" + "---|" * len(names))))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(*attention_order()))
    parts.append(operations.select(*scope, F.lit(6).alias("section"), place.alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))
    if "notes" in operations.columns:
        noted = operations.where("notes <> ''")
        parts.append(noted.select(*scope, F.lit(7).alias("section"), F.row_number().over(Window.partitionBy(*scope).orderBy(*attention_order())).alias("place"), F.concat(F.lit("- `"), "id", F.lit("`: "), "notes").alias("line")))
    parts.append(lines(counts, 8, *[F.lit(f"{i}. {text}") for i, text in enumerate(CONFIRM, 1)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def needs_attention() -> Column:
    """Low confidence, a gate, or nothing known but the placeholder."""
    return (F.col("confidence") == "low") | (F.size("gate") > 0) | (F.col("requires") == F.array(F.lit("external.call")))


def report_note() -> Column:
    """What a report says beside a resolved operation."""
    asked = F.when(F.size("missing") > 0, F.array_join("missing", ", ")).otherwise("human")
    script = F.concat(F.lit("stand-in "), "stand_in", F.lit(" f="), F.col("fidelity").cast("string"))
    return F.when(F.col("binding") == "script", script).when(F.col("binding") == "ask-user", F.concat(F.lit("needs "), asked)).when(F.col("binding") == "drop", "optional, lost").otherwise("")


def summary_lines(summary: DataFrame, key: list[str]) -> DataFrame:
    """The summary block of a report as rows (key, place, line), from routing.summarise."""
    lines = [
        F.concat(F.lit("operations "), "operations", F.lit("   required "), "required", F.lit("   optional "), "optional"),
        F.concat(F.lit("native "), "n_native", F.lit("   mcp "), "n_mcp", F.lit("   script "), "n_script", F.lit("   ask-user "), "n_ask_user", F.lit("   drop "), "n_drop"),
        F.concat(F.lit("all required operations executable: "), F.when(F.col("executable"), "yes").otherwise("no")),
        F.concat(F.lit("gates enforced: "), F.when(F.size("gates") > 0, F.array_join("gates", ", ")).otherwise("-"), F.lit("  ("), "gate_count", F.lit(" total)")),
        F.concat(F.lit("gates deferred: "), F.when(F.size("deferred_gates") > 0, F.array_join("deferred_gates", ", ")).otherwise("-")),
    ]
    return summary.select(*key, F.posexplode(F.array(*lines)).alias("place", "line"))


def eval_layers(results: DataFrame) -> DataFrame:
    """Checks by layer (layer, status): passed, failed, skipped, and ok, which needs a pass and no failure: a skip is no pass."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = results.groupBy("layer").agg(count("pass").alias("passed"), count("fail").alias("failed"), count("skip").alias("skipped"))
    return out.withColumn("ok", (F.col("failed") == 0) & (F.col("passed") > 0))
