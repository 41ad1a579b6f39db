"""Operations of repositories that declare none: from traced sites, else from dependencies; and one for what is unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.effects import effect_sites, python_calls
from tidemark.operators import fusion
from tidemark.operators.inventory import build_inventory, match_providers
from tidemark.sources.tables import materialise

#: How many unknown dependencies an operation names as evidence.
MOST_NAMED = 20
COLUMNS = ("repo", "id", "name", "stage", "effect", "requires", "gate", "optional", "confidence", "loc", "summary")


def shaped(rows: DataFrame, requires: Column, gate: Column, **columns: Column) -> DataFrame:
    """The columns that all ways to an operation share; the stage follows from them unless it is given."""
    stage = columns.pop("stage", None)
    rows = rows.withColumn("requires", requires).withColumn("gate", gate)
    stage = T.infer_phase(columns.pop("told_by"), columns["effect"], F.col("requires"), F.col("gate")) if stage is None else stage
    return rows.select("repo", columns["id"].alias("id"), columns["name"].alias("name"), stage.alias("stage"), columns["effect"].alias("effect"), "requires", "gate", columns["optional"].alias("optional"), columns["confidence"].alias("confidence"), columns["loc"].alias("loc"), columns["summary"].alias("summary"))


def empty() -> Column:
    return F.array().cast("array<string>")


def from_sites(sites: DataFrame) -> DataFrame:
    """One operation for each file and capability of ``sites`` (repo, rel, line, capability, effect)."""
    rows = sites.groupBy("repo", "rel", "capability").agg(fusion.dominant_effect("effect", "line").alias("strongest"), F.min("line").alias("line"), F.count("*").alias("n"))
    stem = F.regexp_replace(F.substring_index("rel", "/", -1), r"\.py$", "")
    return shaped(
        rows, F.array("capability"), empty(), id=T.slugify(F.concat_ws("-", "capability", stem)), name=F.concat_ws(" in ", "capability", "rel"), told_by=F.col("capability"), effect=F.col("strongest"),
        optional=F.lit(False), confidence=F.lit("medium"), loc=F.concat_ws(":", "rel", "line"), summary=F.concat(F.lit("derived from "), F.col("n"), F.lit(" traced effect sites")),
    )


def from_providers(known: DataFrame) -> DataFrame:
    """One operation for each provider among a repository's dependencies; the first dependency by name stands for it."""
    rows = fusion.first_by(known.select("repo", "provider", "ecosystem", "name", "caps", "gates", "ambiguous"), ["repo", "provider"], ["ecosystem", "name"]).where(F.size("caps") > 0)
    return shaped(
        rows, F.array_sort(F.array_distinct("caps")), F.array_sort(F.array_distinct("gates")), id=T.slugify(F.concat(F.lit("use-"), "provider")), name=F.concat(F.lit("Use "), "provider"), told_by=F.col("provider"),
        effect=F.lit("effectful-external"), optional=F.lit(False), confidence=F.when(F.col("ambiguous"), "low").otherwise("medium"), loc=F.lit("manifest"), summary=F.concat(F.lit("dependency "), "name", F.lit(" ("), "ecosystem", F.lit(")")),
    )


def unresolved(unknown: DataFrame) -> DataFrame:
    """One optional operation for a repository with unknown dependencies; ``evidence`` holds the first MOST_NAMED of them.

    The list is cut by rank before it is gathered; the count covers all.
    """
    place = F.row_number().over(Window.partitionBy("repo").orderBy("ecosystem", "name"))
    placed = unknown.select("repo", "ecosystem", "name").distinct().withColumn("place", place)
    label = F.when(F.col("place") <= MOST_NAMED, F.struct("place", F.concat_ws(":", "ecosystem", "name").alias("label")))
    rows = placed.groupBy("repo").agg(F.array_sort(F.collect_list(label)).alias("first"), F.count("*").alias("n"))
    out = rows.withColumn("evidence", F.transform("first", lambda x: x["label"]))
    base = shaped(
        out, F.array(F.lit("external.call")), empty(), id=F.lit("unresolved-external-calls"), name=F.lit("Unresolved external calls"), stage=F.lit("transform"), effect=F.lit("effectful-external"),
        optional=F.lit(True), confidence=F.lit("low"), loc=F.lit("manifest"), summary=F.concat(F.col("n"), F.lit(" dependencies outside the catalogue")),
    )
    return base.join(out.select("repo", "evidence"), "repo")


def ladder(declared: DataFrame, sites: DataFrame, providers: DataFrame) -> DataFrame:
    """For each repository the operations of the first way that yields any: declared, else sites, else providers."""
    second = sites.join(declared.select("repo").distinct(), "repo", "left_anti")
    have = declared.select("repo").unionByName(sites.select("repo")).distinct()
    third = providers.join(have, "repo", "left_anti")
    return declared.withColumn("way", F.lit("declared")).unionByName(second.withColumn("way", F.lit("sites"))).unionByName(third.withColumn("way", F.lit("providers")))


def draft_inventory(files: DataFrame, deps: DataFrame) -> DataFrame:
    """Every repository's operations by the ladder, and one for its unknown dependencies."""
    declared = materialise(build_inventory(files, deps).select(*COLUMNS), "declared")
    known, unknown = match_providers(deps)
    rows = ladder(declared, from_sites(effect_sites(python_calls(files))), from_providers(known))
    return rows.unionByName(unresolved(unknown).select(*COLUMNS).withColumn("way", F.lit("unresolved")))
