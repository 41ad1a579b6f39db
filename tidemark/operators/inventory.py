"""From files to an inventory: declarations, call sites, dependencies and documents fused into operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.dialects import candidates, line_rows
from tidemark.functions.effects import effect_sites, python_calls
from tidemark.operators import attribution, fusion, selection
from tidemark.sources.catalogues import IGNORED_PACKAGES, provider_table
from tidemark.sources.repos import stored
from tidemark.sources.tables import materialise

DOCUMENTS = r"(?i)([.](md|rst|txt)$|readme|contributing|architecture|security|adr)"
#: Families of capabilities whose results come from a model.
GENERATIVE = ("text", "image", "video", "audio", "ml")


def match_providers(deps: DataFrame, ignored: DataFrame | None = None, providers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Dependencies (repo, ecosystem, name) with their provider, and the unknown ones.

    Package names of tools and frameworks tell of no capability and are left out in every ecosystem: IGNORED_PACKAGES, or
    ``ignored`` (name). ``providers`` replaces the shipped catalogue.
    """
    deps = deps.where(~F.col("name").isin(*IGNORED_PACKAGES)) if ignored is None else deps.join(ignored, "name", "left_anti")
    table = provider_table(deps.sparkSession) if providers is None else providers
    met = deps.join(table, ["ecosystem", "name"], "left")  # broadcast if its size allows: Spark checks that
    return met.where("provider is not null"), met.where("provider is null").select("repo", "ecosystem", "name")


def document_lines(files: DataFrame, most: int = 40) -> DataFrame:
    """Lines of the first ``most`` documents of a repository by path: repo, rel, line, text_line, low. A limit of the feature."""
    docs = selection.first_files(files.where(F.col("rel").rlike(DOCUMENTS)).select("repo", "rel"), ["repo"], "rel", most)
    lines = line_rows(files.join(docs.select("repo", "rel"), ["repo", "rel"], "left_semi"))
    return lines.withColumn("text_line", F.trim("text_line")).where("text_line <> ''").withColumn("low", F.lower("text_line"))


def gate_signals(lines: DataFrame) -> DataFrame:
    """Gate language in documents, one signal for each line and gate."""
    return lines.select("repo", "rel", "line", "text_line", F.explode(T.gates_of(F.col("text_line"), F.col("low"))).alias("gate"))


def optional_operations(lines: DataFrame, operations: DataFrame) -> DataFrame:
    """(repo, id) of operations (repo, id, name) of which a word of over three characters stands in a line of optional language.

    A word counts inside longer ones too. Lines are cut into all pieces of their words that are as long as some name's word,
    so the match is an equi-join and no line meets every operation.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.translate("name", "-_", "  ")), r"\s+"), lambda w: F.length(w) > 3))
    asked = operations.select("repo", "id", F.explode(words).alias("word")).withColumn("n", F.length("word"))
    lengths = F.broadcast(asked.select("n").distinct())  # word lengths: a few dozen rows at most
    told = lines.where(T.is_optional(F.col("text_line"), F.col("low"))).select("repo", F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("w")).distinct()
    pieces = told.join(lengths, F.length("w") >= F.col("n")).select("repo", "n", F.explode(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1)).alias("at"), "w")
    pieces = pieces.select("repo", F.substring(F.col("w"), F.col("at"), F.col("n")).alias("word")).distinct()
    return asked.join(pieces, ["repo", "word"], "left_semi").select("repo", "id").distinct()


def is_deterministic(requires: Column, effect: Column) -> Column:
    """No capability comes from a model, and the effect stays local."""
    generative = F.exists(requires, lambda c: F.substring_index(c, ".", 1).isin(*GENERATIVE))
    return ~generative & F.coalesce(effect.isin("read-local", "effectful-local"), F.lit(False))


def deterministic(operations: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, deterministic) by a vocabulary (capability, kind): is_deterministic where kinds are a catalogue's."""
    kinds = operations.select("id", "effect", F.explode_outer("requires").alias("capability")).join(vocabulary.select("capability", "kind"), "capability", "left")
    made = F.coalesce(F.bool_or(F.col("kind") == "generative"), F.lit(False))
    return kinds.groupBy("id").agg((~made & F.coalesce(F.first("effect").isin("read-local", "effectful-local"), F.lit(False))).alias("deterministic"))


def provider_hits(operations: DataFrame, providers: DataFrame) -> DataFrame:
    """What the providers (provider, caps, gates, ambiguous) that share a capability with an operation tell of it.

    id, corroboration, ambiguous, gate_hints. Both sides are exploded, so the overlap is an equi-join.
    """
    by_cap = providers.select("provider", "gates", "ambiguous", F.explode("caps").alias("c"))
    met = operations.select("id", F.explode("requires").alias("c")).join(by_cap, "c").drop("c").distinct()
    hints = F.array_sort(F.array_distinct(F.flatten(F.collect_set("gates"))))
    return met.groupBy("id").agg(F.count_distinct("provider").alias("corroboration"), F.bool_or("ambiguous").alias("ambiguous"), hints.alias("gate_hints"))


def default_stand_in(requires: Column, defaults: dict[str, str]) -> Column:
    """The stand-in of the first required capability that has one by default."""
    if not defaults:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.try_element_at(F.filter(F.transform(requires, lambda c: table[c]), lambda s: s.isNotNull()), F.lit(1))


def claim_sites(cands: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites with the operation that owns them (repo, id, weak), and the sites of files where several could.

    Each site goes to the innermost declaration around it, left-over ones to the only declaration of their file without a
    range (weakly). Where no declaration of a file could own a left-over site, it is dropped.
    """
    cols = ["repo", "rel", "line", "capability", "effect", "detail"]
    ranged, rangeless = cands.where("lo is not null"), cands.where("lo is null")
    inner = attribution.claim_innermost(sites.select(*cols), ranged.select("repo", "rel", "lo", "hi", "id", F.col("line").alias("at")), ["repo", "rel"], "line", "lo", "hi", "line", "at")
    left = attribution.claim_leftovers(sites.select(*cols), ranged.select("repo", "rel", "lo", "hi"), rangeless.select("repo", "rel", F.col("id").alias("owner")), ["repo", "rel"], "line", "lo", "hi", "owner")
    owned = inner.select(*cols, "id", F.lit(False).alias("weak")).unionByName(left.where("weak").select(*cols, F.col("owner").alias("id"), "weak"))
    return owned, left.where("not weak").select(*cols)


def evidence_of(rows: DataFrame, source: str, loc: Column, detail: Column, ord: int) -> DataFrame:
    """Evidence rows of operations: repo, id, source, loc, detail, ord."""
    return rows.select("repo", "id", F.lit(source).alias("source"), loc.alias("loc"), detail.alias("detail"), F.lit(ord).alias("ord"))


# What evidence and notes say.
ASSERTS, UNTRACED, IN_DOCUMENTS = "declaration asserts: ", "no effect traced for this operation; requires external.call as a placeholder pending review", "gate language detected in documentation ("
FROM_DECLARATIONS = "capabilities come from declaration sites, not traced effects"


def build_inventory(files: DataFrame, deps: DataFrame | None = None, classes: DataFrame | None = None, stand_ins: dict[str, str] | None = None, providers: DataFrame | None = None) -> DataFrame:
    """Declared operations of every repository, with all that is known of them.

    Columns: repo, id, name, stage, effect, requires, gate, gate_confidence, optional, deterministic, confidence, evidence,
    summary, credentials, stand_in, trigger, kind, loc, inputs, dialect, notes. Capabilities are those traced in the
    operation's body and those that its declaration tells; without any it requires the placeholder external.call.
    ``classes`` (repo, repo_class) leaves out dialects that don't fit a repository.
    """
    files = stored(files)
    cands = materialise(candidates(files, classes), "candidates")
    owned = materialise(claim_sites(cands, effect_sites(python_calls(files)))[0], "owned")
    traced = owned.groupBy("repo", "id").agg(F.array_sort(F.collect_set("capability")).alias("traced"), fusion.dominant_effect("effect", "line").alias("traced_effect"), F.bool_or("weak").alias("weak"))
    lines = materialise(document_lines(files), "lines")
    named, _ = attribution.associate_gates(gate_signals(lines), cands.select("repo", F.col("id").alias("op_id"), "name"), "text_line", ["rel", "line"], ("repo",))
    named = materialise(named.withColumnRenamed("op_id", "id"), "gates")
    gates = named.groupBy("repo", "id").agg(F.array_sort(F.collect_set("gate")).alias("doc_gates"))
    optional = optional_operations(lines, cands).withColumn("optional", F.lit(True))

    none = F.array().cast("array<string>")
    rows = cands.join(traced, ["repo", "id"], "left").join(gates, ["repo", "id"], "left").join(optional, ["repo", "id"], "left")
    at, proof = F.col("loc"), []
    proof.append(evidence_of(cands, "declared", at, F.when(F.col("detail") != "", F.col("detail")).otherwise(F.col("dialect")), 0))
    proof.append(evidence_of(owned, "traced", F.concat_ws(":", "rel", F.col("line").cast("string")), F.col("detail"), 1))
    proof.append(evidence_of(cands.where(F.size("caps") > 0), "declared", at, F.concat(F.lit(ASSERTS), F.array_join(F.array_sort("caps"), ", ")), 2))
    hints, supports, open_use, creds = none, F.lit(0), F.lit(False), F.lit(None).cast("array<struct<name:string,kind:string,env:string>>")
    if deps is not None:
        known, _ = match_providers(deps, providers=providers)
        caps = known.select("repo", "provider", "ecosystem", "name", "gates", "ambiguous", "credentials", F.explode("caps").alias("capability"))
        met = materialise(owned.select("repo", "id", "capability").distinct().join(caps, ["repo", "capability"]).drop("capability").distinct(), "providers")
        told = met.groupBy("repo", "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gates")))).alias("hints"), F.count_distinct("provider").alias("n_providers"), F.bool_or("ambiguous").alias("ambiguous"))
        paid = met.select("repo", "id", F.explode("credentials").alias("c"), F.concat_ws(":", "ecosystem", "name").alias("ord"))
        paid = selection.credentials(paid.select("repo", "id", "c.name", "c.kind", "c.env", "ord"), ["repo", "id"])
        rows = rows.join(told, ["repo", "id"], "left").join(paid, ["repo", "id"], "left")
        hints, supports, open_use, creds = F.coalesce("hints", none), F.coalesce("n_providers", F.lit(0)), F.coalesce("ambiguous", F.lit(False)), F.col("credentials")
        detail = F.concat("ecosystem", F.lit(":"), "name", F.lit(" -> "), "provider", F.when(F.col("ambiguous"), " (ambiguous)").otherwise(""))
        proof.append(evidence_of(met, "inferred", F.lit("manifest"), detail, 3))
    found = F.array_sort(F.array_union(F.coalesce("traced", none), F.col("caps")))
    rows = rows.withColumn("found", found).withColumn("own_gates", F.coalesce("doc_gates", none))
    placeholder = F.size("found") == 0
    bare = cands.join(owned.select("repo", "id").distinct(), ["repo", "id"], "left_anti").where(F.size("caps") == 0)
    proof.append(evidence_of(bare, "proposed", at, F.lit(UNTRACED), 4))
    proof.append(evidence_of(named.select("repo", "id", "rel", "line", "gate"), "documented", F.concat_ws(":", "rel", F.col("line").cast("string")), F.concat(F.lit(IN_DOCUMENTS), "gate", F.lit(")")), 5))
    every = proof[0]
    for p in proof[1:]:
        every = every.unionByName(p)
    listed = fusion.distinct_evidence(every, ["repo", "id"])

    effect = F.coalesce("traced_effect", "effect", F.lit("effectful-external"))
    gate = F.array_sort(F.array_union("own_gates", hints))
    requires = F.when(placeholder, F.array(F.lit("external.call"))).otherwise(F.col("found"))
    sources = F.array_compact(F.array(F.lit("declared"), F.when(F.size(F.coalesce("traced", none)) > 0, "traced"), F.when(supports > 0, "inferred"), F.when(F.size("own_gates") > 0, "documented")))
    fused = fusion.fuse_confidence(sources, supports, open_use, F.coalesce("weak", F.lit(False)), placeholder)
    untraced = (F.size("caps") > 0) & F.col("traced").isNull() & (fused == "high")
    rows = rows.join(listed, ["repo", "id"])
    return rows.select(
        "repo", "id", "name", T.infer_phase(F.col("name"), effect, requires, gate).alias("stage"), effect.alias("effect"), requires.alias("requires"), gate.alias("gate"),
        F.when(F.size(hints) > 0, "medium").when(F.size(gate) > 0, "low").alias("gate_confidence"), F.coalesce("optional", F.lit(False)).alias("optional"), is_deterministic(requires, effect).alias("deterministic"),
        F.when(untraced, "medium").otherwise(fused).alias("confidence"), "evidence", F.col("detail").alias("summary"), F.coalesce(creds, F.array().cast("array<struct<name:string,kind:string,env:string>>")).alias("credentials"),
        default_stand_in(requires, stand_ins or {}).alias("stand_in"), "trigger", "kind", "loc", "inputs", "dialect",
        F.when(untraced, FROM_DECLARATIONS).otherwise("").alias("notes"),
    )
