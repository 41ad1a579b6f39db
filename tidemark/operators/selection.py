"""Choosing, numbering and counting operations, files and credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import fusion

#: Seconds that a stand-in may run: default and ceiling.
DEFAULT_SECONDS, MOST_SECONDS = 120, 900


def selected(operations: DataFrame, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The operations whose key is wanted, and the wanted keys that no operation has."""
    return operations.join(wanted.select(*key).distinct(), key, "left_semi"), wanted.select(*key).distinct().join(operations.select(*key), key, "left_anti")


def numbered(operations: DataFrame, scope: list[str]) -> DataFrame:
    """Operations of a scope with their 1-based number by stage, then id."""
    return operations.withColumn("number", F.row_number().over(Window.partitionBy(*scope).orderBy("stage", "id")))


def by_id(operations: DataFrame, scope: list[str]) -> DataFrame:
    """The final order of an inventory: operations of a scope by id, with their place."""
    return operations.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy("id")))


def first_files(files: DataFrame, scope: list[str], order: str, most: int, first: Column | None = None) -> DataFrame:
    """The first ``most`` files of each scope, those with ``first`` before all others: a limit of the feature."""
    lead = F.lit(1) if first is None else F.when(first, 0).otherwise(1)
    return files.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy(lead, order))).where(F.col("place") <= most)


def cues(sentences: DataFrame, scope: list[str], order: str, text: str, least_ms: int = 4000, chars_a_second: int = 18) -> DataFrame:
    """Sentences with span_ms and start_ms: how long each is shown, and when it begins after those before it in its scope."""
    span = F.greatest(F.lit(least_ms), F.floor(F.length(text) * 1000 / chars_a_second)).cast("long")
    before = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sentences.withColumn("span_ms", span).withColumn("start_ms", F.coalesce(F.sum("span_ms").over(before), F.lit(0)))


def membership(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Each key with ``added``, ``removed`` or ``both``."""
    a, b = old.select(*key).distinct().withColumn("was", F.lit(True)), new.select(*key).distinct().withColumn("is", F.lit(True))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("both")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def credentials(matches: DataFrame, key: list[str]) -> DataFrame:
    """Distinct credentials (name, kind) of an operation, each with its first variable, in order of appearance."""
    once = fusion.first_by(matches.select(*key, "name", "kind", "env", "ord"), [*key, "name", "kind"], ["ord"])
    listed = F.array_sort(F.collect_list(F.struct("ord", "name", "kind", "env")))
    return once.groupBy(*key).agg(F.transform(listed, lambda c: F.struct(c["name"].alias("name"), c["kind"].alias("kind"), c["env"].alias("env"))).alias("credentials"))


def coalesced(operations: DataFrame, scope: list[str], cls: str) -> tuple[DataFrame, DataFrame]:
    """Merge, drop plumbing, cap; and by scope how many operations each pass took away."""
    merged = fusion.merge_operations(operations, [*scope, cls])
    needed = fusion.drop_plumbing(merged)
    kept = fusion.cap_by_class(needed, scope, cls)
    counts = operations.groupBy(*scope).agg(F.count("*").alias("n"))
    for name, rows in (("n_merged", merged), ("n_needed", needed), ("n_kept", kept)):
        counts = counts.join(rows.groupBy(*scope).agg(F.count("*").alias(name)), scope, "left").na.fill(0, [name])
    notes = counts.select(*scope, (F.col("n") - F.col("n_merged")).alias("duplicates"), (F.col("n_merged") - F.col("n_needed")).alias("plumbing"), (F.col("n_needed") - F.col("n_kept")).alias("over_limit"), "n_kept")
    return kept, notes


def standin_status(operations: DataFrame, standins: DataFrame, tools: DataFrame) -> DataFrame:
    """runnable, blocked (a tool is missing) or not-runnable (no stand-in, or one without a script) for each operation.

    standins: stand_in, script (null where it has none), tools; tools: tool. Both are catalogues.
    """
    lacking = standins.select("stand_in", F.explode("tools").alias("tool")).join(tools, "tool", "left_anti").groupBy("stand_in").agg(F.array_sort(F.collect_set("tool")).alias("lacks"))
    known = standins.join(lacking, "stand_in", "left")
    status = F.when(F.col("script").isNull(), "not-runnable").when(F.col("lacks").isNotNull(), "blocked").otherwise("runnable")
    return operations.join(known, "stand_in", "left").withColumn("status", status)


def catalogue_gaps(known: DataFrame, unknown: DataFrame, scope: list[str]) -> DataFrame:
    """How many dependencies of a scope the catalogue knows and how many it doesn't."""
    both = known.select(*scope, F.lit(1).alias("k")).unionByName(unknown.select(*scope, F.lit(0).alias("k")))
    return both.groupBy(*scope).agg(F.count_if(F.col("k") == 1).alias("matched"), F.count_if(F.col("k") == 0).alias("unknown"))


def suitability(n_operations: Column, n_documents: Column, n_code: Column) -> Column:
    """suitable with any operation; knowledge-only where documents or code are worth capturing; else not-suitable."""
    return F.when(n_operations > 0, "suitable").when((n_documents >= 3) | (n_code >= 10), "knowledge-only").otherwise("not-suitable")


def timeout(value: Column) -> Column:
    """Whole seconds from text; the default for what isn't a positive number; never over the ceiling."""
    n = value.try_cast("int")
    return F.least(F.when(n > 0, n).otherwise(DEFAULT_SECONDS), F.lit(MOST_SECONDS))
