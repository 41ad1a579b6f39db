"""Packages: what a routed inventory says to its user, as lines of files; and what may not be emitted.

A package belongs to one scope (an inventory) and one profile. Its files are rows (package, rel, section, at, place, line), in that
order; no document is ever one value here. ``sources.packages`` writes such rows as folders and reads them back.

rows:  scope, profile, id, stage, effect, requires, optional, confidence, binding, gates, deferred_gates, missing, stand_in,
       fidelity, coverage (of routing.resolve)
meta:  scope, url, sha, status, repo_class          stand-ins: stand_in, desc, caveat, script
evidence: scope, id, ord, source, loc, detail        scripts: script, text
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import skill_name
from tidemark.operators import routing

LINE = ["package", "rel", "section", "at", "place", "line"]
SKILL, BINDINGS, DEGRADATION, BLOCKED, GATES = "SKILL.md", "references/bindings.md", "references/degradation.md", "references/blocked.md", "references/gates.md"
REFUSAL = "NOT-SUITABLE.md"
#: What each channel means to a reader.
CHANNELS = {
    "native": "done by the harness itself", "mcp": "reached through a service", "script": "replaced by a declared stand-in", "ask-user": "stops for a person", "drop": "optional and left out",
}
GATE_MEANING = {
    "publish": "something leaves for the outside", "spend": "money is spent", "irreversible": "nothing brings it back", "legal": "rights or duties are touched", "privacy": "personal data is touched",
}


def say(*parts: str | Column) -> Column:
    """A line of texts and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def code(c: str | Column) -> Column:
    return say("`", F.col(c) if isinstance(c, str) else c, "`")


def listed(c: str | Column, none: str = "-") -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)


def row(*cells: Column) -> Column:
    return say("| ", F.concat_ws(" | ", *cells), " |")


def package_name() -> Column:
    return skill_name(F.coalesce("url", F.lit("tree")), F.col("profile"))


def refusals(rows: DataFrame, meta: DataFrame, scope: list[str], accept_unreviewed: bool = False, reported: DataFrame | None = None) -> DataFrame:
    """Packages that may not be emitted: scope, profile, reason, and how many operations give it.

    Reasons: draft (nobody has reviewed the inventory, unless that is accepted), name-taken (another package has the same name), each
    broken invariant (``rows`` needs gate and declared_stand_in for them), and gates that a question leaves out (``rows`` with
    ``question``).
    """
    key = [*scope, "profile"]
    names = rows.select(*key).distinct().join(meta.select(*scope, "url"), scope).withColumn("name", package_name())
    twice = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    twice = names.join(twice, "name", "left_semi").select(*key, F.lit("name-taken").alias("reason"))
    drafts = rows.select(*key).distinct().join(meta.where("status = 'draft'").select(*scope), scope, "left_semi").select(*key, F.lit("draft").alias("reason"))
    broken = routing.violations(rows.withColumn("id", F.struct(*scope, "id")), reported).select(*[f"id.{c}" for c in scope], "profile", F.col("invariant").alias("reason"))
    every = broken.unionByName(twice) if accept_unreviewed else broken.unionByName(twice).unionByName(drafts)
    if "question" in rows.columns:
        silent = routing.unsurfaced_gates(rows.withColumn("id", F.struct(*scope, "id")))
        every = every.unionByName(silent.select(*[f"id.{c}" for c in scope], "profile", F.lit("gate-not-asked").alias("reason")))
    return every.groupBy(*key, "reason").agg(F.count("*").alias("n"))


def package_lines(rows: DataFrame, meta: DataFrame, scope: list[str], standins: DataFrame, evidence: DataFrame | None = None, scripts: DataFrame | None = None) -> DataFrame:
    """The files of every package of resolved rows."""
    key, info = [*scope, "profile"], meta.withColumn("status", F.when(F.col("status") == "draft", "accepted-unreviewed").otherwise(F.col("status")))
    told = rows.join(info, scope).withColumn("package", package_name()).join(standins.select("stand_in", "desc", "caveat", "script"), "stand_in", "left")
    bp = F.sum(F.when(~F.col("optional"), F.round(F.col("coverage") * 10000).cast("long"))).alias("bp")
    summary = routing.summarise(rows, tuple(key), bp).join(info, scope).withColumn("package", package_name())
    parts = [heads(summary), operations_table(told), stops(told), reference_rows(told)]
    if evidence is not None:
        parts.append(evidence_lines(told, evidence, scope))
    if scripts is not None:
        used = told.where("stand_in is not null and script is not null").select("package", "script").distinct()
        parts.append(file_lines(used.join(scripts, "script").select("package", F.concat(F.lit("scripts/"), "script").alias("rel"), "text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_lines(files: DataFrame) -> DataFrame:
    """Whole texts (package, rel, text) as lines."""
    body = F.regexp_replace("text", r"\n\z", "")
    return files.select("package", "rel", F.lit(0).alias("section"), F.lit("").alias("at"), F.posexplode(F.split(body, "\n")).alias("place", "line"))


def lines_of(rows: DataFrame, blocks: list[tuple[str, int, Column | None, list[Column | str]]], at: Column | None = None) -> DataFrame:
    """Lines that every row gives: (rel, section, condition or None, lines); null lines are left out."""
    made = []
    for rel, section, condition, lines in blocks:
        for i, line in enumerate(lines):
            text = F.lit(line) if isinstance(line, str) else line
            text = text if condition is None else F.when(condition, text)
            made.append(F.struct(F.lit(rel).alias("rel"), F.lit(section).alias("section"), F.lit(i).alias("place"), text.alias("line")))
    out = rows.select("package", (F.lit("") if at is None else at).alias("at"), F.explode(F.filter(F.array(*made), lambda x: x["line"].isNotNull())).alias("x"))
    return out.select("package", "x.rel", "x.section", "at", "x.place", "x.line")


def heads(s: DataFrame) -> DataFrame:
    """What stands once in a package: front matter, titles, the profile, heads of tables, closing remarks."""
    n, status = F.col("operations").cast("string"), F.coalesce("status", F.lit("unknown"))
    where = F.coalesce("url", F.lit("a local tree"))
    percent = F.coalesce(F.floor(F.col("bp") / F.when(F.col("required") > 0, F.col("required"))), F.lit(0)).cast("long")
    coverage = say(F.expr("cast(x div 100 as string)".replace("x", "cov")), ".", F.lpad(F.expr("cast(cov % 100 as string)"), 2, "0"), " %")
    s = s.withColumn("cov", percent)
    asks, scripts, drops = F.col("n_ask_user") > 0, F.col("n_script") > 0, F.col("n_drop") > 0
    gated, deferred, odd = F.size("gates") > 0, F.size("deferred_gates") > 0, status == "accepted-unreviewed"
    counts = [row(F.lit(b), F.col("n_" + b.replace("-", "_")).cast("string"), F.lit(text)) for b, text in CHANNELS.items()]
    return lines_of(s, [
        (SKILL, 0, None, [
            "---", say("name: ", F.col("package")), say("description: Work with ", where, " in ", n, " operations, each bound for the profile ", F.col("profile"), ", with what is replaced, asked or left out said beforehand."),
            "license: MIT", say("compatibility: made for the profile ", F.col("profile"), F.coalesce(say(" at ", F.col("sha")), F.lit(""))), "metadata:", say("  repo_class: ", F.coalesce("repo_class", F.lit("unknown"))),
            say("  profile: ", F.col("profile")), say("  inventory_status: ", status), say("  source: ", F.col("url")), say("  source_sha: ", F.col("sha")), "---", "",
        ]),
        (SKILL, 1, None, [
            say("# Operations of ", where), "", "## Profile", "", say("All bindings below hold for the profile `", F.col("profile"), "` and for no other."), "", "| Channel | Operations | Meaning |", "|---|---|---|", *counts, "",
            say("Coverage of required operations: **", coverage, "**"), "", F.when(F.col("executable"), "All required operations run here.").otherwise(say("**", F.col("n_halted").cast("string"), "** required operation(s) stop for a person and **", F.col("n_lost").cast("string"), "** are lost.")), "",
        ]),
        (SKILL, 2, odd, ["## Not reviewed", "", "Nobody has confirmed this inventory; these operations are the least certain:", ""]),
        (SKILL, 4, odd, [""]),
        (SKILL, 5, None, ["## Operations in order", "", "| # | Operation | Stage | Effect | Binding | Gates | Confidence |", "|---|---|---|---|---|---|---|"]),
        (SKILL, 7, None, ["", "## Where it stops", ""]),
        (SKILL, 8, asks, ["Stop for a person:", ""]), (SKILL, 10, asks, [""]),
        (SKILL, 11, scripts, ["Run as something lesser; say so in what is delivered:", ""]), (SKILL, 13, scripts, [""]),
        (SKILL, 14, drops, ["Left out:", ""]), (SKILL, 16, drops, [""]),
        (SKILL, 17, ~asks & ~scripts & ~drops, ["Nothing stops, is replaced or left out.", ""]),
        (SKILL, 18, None, ["## Gates", "", F.when(gated, say("Held here: ", listed("gates"), ".")).otherwise("No gate is held here."), F.when(deferred, say("Left to the questions: ", listed("deferred_gates"), "."))]),
        (SKILL, 19, None, ["", "## References", "", "- `references/bindings.md`", F.when(scripts, "- `references/degradation.md`"), F.when(asks, "- `references/blocked.md`"), "- `references/gates.md`"]),
        (BINDINGS, 0, None, ["# Bindings", "", say("Profile `", F.col("profile"), "`, ", n, " operations."), "", "| Operation | Stage | Effect | Requires | Binding | Gates | Confidence |", "|---|---|---|---|---|---|---|"]),
        (BINDINGS, 2, None, ["", "## Evidence", ""]),
        (DEGRADATION, 0, None, ["# Degradation", "", F.when(scripts, "| Operation | Stand-in | Fidelity | Runs as | Instead | Caveat |").otherwise("Nothing runs as something lesser."), F.when(scripts, "|---|---|---|---|---|---|")]),
        (BLOCKED, 0, None, ["# Questions", "", F.when(~asks, "Nothing needs to be asked.")]),
        (GATES, 0, None, ["# Gates", "", "| Gate | Meaning |", "|---|---|", *[row(code(F.lit(g)), F.lit(m)) for g, m in GATE_MEANING.items()], ""]),
        (GATES, 1, gated, ["## Held", "", "| Operation | Gates |", "|---|---|"]), (GATES, 3, gated, [""]),
        (GATES, 4, deferred, ["## Left to questions", "", "| Operation | Gates |", "|---|---|"]), (GATES, 6, deferred, [""]),
        (GATES, 7, ~gated & ~deferred, ["No operation has a gate."]),
    ])


def operations_table(told: DataFrame) -> DataFrame:
    """The numbered table of a package's operations, by stage and id."""
    place = F.row_number().over(Window.partitionBy("package").orderBy("stage", "id"))
    shown = F.when(F.size("gates") > 0, F.array_join("gates", ", ")).when(F.size("deferred_gates") > 0, say("asked: ", F.array_join("deferred_gates", ", "))).otherwise("-")
    line = row(place.cast("string"), code("id"), F.col("stage"), F.col("effect"), F.col("binding"), shown, F.col("confidence"))
    return told.select("package", F.lit(SKILL).alias("rel"), F.lit(6).alias("section"), F.lit("").alias("at"), place.alias("place"), line.alias("line"))


def stops(told: DataFrame) -> DataFrame:
    """Rows of uncertain, asked, replaced and dropped operations in the main file."""
    bound = lambda b: F.col("binding") == b
    low = (F.col("status") == "accepted-unreviewed") & (F.col("confidence") == "low")
    asked = say("- ", code("id"), " lacks ", listed("missing", "a decision"), F.when(F.size("deferred_gates") > 0, say("; ask about ", listed("deferred_gates"))).otherwise(""))
    lesser = say("- ", code("id"), ": ", F.coalesce("desc", F.lit("no description")), " (stand-in ", code("stand_in"), ")")
    return lines_of(told, [
        (SKILL, 3, low, [say("- ", code("id"), " needs ", listed("requires", "nothing"))]),
        (SKILL, 9, bound("ask-user"), [asked]),
        (SKILL, 12, bound("script"), [lesser]),
        (SKILL, 15, bound("drop"), [say("- ", code("id"))]),
    ], F.col("id"))


def reference_rows(told: DataFrame) -> DataFrame:
    """Rows of the reference files."""
    bound = lambda b: F.col("binding") == b
    fidelity = F.floor(F.round(F.col("fidelity") * 100)).cast("string")
    question = routing.question(F.col("id"), F.col("missing"), F.col("deferred_gates"))
    runs = F.coalesce(say("`scripts/", F.col("script"), "`"), F.lit("not runnable"))
    return lines_of(told, [
        (BINDINGS, 1, None, [row(code("id"), F.col("stage"), F.col("effect"), listed("requires"), F.col("binding"), listed("gates"), F.col("confidence"))]),
        (DEGRADATION, 1, bound("script"), [row(code("id"), code("stand_in"), say(F.coalesce(fidelity, F.lit("?")), " %"), runs, F.coalesce("desc", F.lit("-")), F.coalesce("caveat", F.lit("-")))]),
        (BLOCKED, 1, bound("ask-user"), [say("## ", code("id")), "", question, ""]),
        (GATES, 2, F.size("gates") > 0, [row(code("id"), listed("gates"))]),
        (GATES, 5, F.size("deferred_gates") > 0, [row(code("id"), listed("deferred_gates"))]),
    ], F.col("id"))


def evidence_lines(told: DataFrame, evidence: DataFrame, scope: list[str]) -> DataFrame:
    """What each operation rests on, under its name; a line where it rests on nothing."""
    ids = told.select("package", *scope, "id")
    item = say("- ", code("source"), " ", F.coalesce("loc", F.lit("?")), F.coalesce(say(": ", F.col("detail")), F.lit("")))
    base = lambda rows, place, line: rows.select("package", F.lit(BINDINGS).alias("rel"), F.lit(3).alias("section"), F.col("id").alias("at"), place.cast("long").alias("place"), line.alias("line"))
    has = evidence.select(*scope, "id").distinct()
    out = base(ids, F.lit(-1), say("### ", code("id"))).unionByName(base(ids.join(evidence, [*scope, "id"]), F.col("ord"), item))
    return out.unionByName(base(ids.join(has, [*scope, "id"], "left_anti"), F.lit(0), F.lit("- nothing recorded")))


def refusal_lines(verdicts: DataFrame, scope: list[str]) -> DataFrame:
    """A document for every scope that isn't suitable: scope, status, source, reasons, evidence (arrays of texts)."""
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in scope])
    rows = verdicts.where("status = 'not-suitable'").withColumn("package", name)
    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    blank, none = F.array(F.lit("")), F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.lit("# Not converted"), F.lit("")), F.when(F.col("source").isNotNull(), F.array(say("Source: ", code("source")), F.lit(""))).otherwise(none), F.array(F.lit("## Why"), F.lit("")), bullets("reasons"), blank,
        F.when(F.size("evidence") > 0, F.concat(F.array(F.lit("## Seen"), F.lit("")), bullets("evidence"), blank)).otherwise(none), F.array(F.lit("## What would help"), F.lit(""), F.lit("An entry point, or a declared surface such as commands, routes, jobs or tools.")),
    )
    return rows.select("package", F.lit(REFUSAL).alias("rel"), F.lit(0).alias("section"), F.lit("").alias("at"), F.posexplode(lines).alias("place", "line"))
