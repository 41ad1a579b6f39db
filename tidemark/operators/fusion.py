"""Evidence fusion: confidence, evidence lists, merging of equal operations, caps, credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: In decreasing order of trust.
SOURCES = ("declared", "traced", "inferred", "documented", "proposed")
EFFECTS = ("read-local", "read-external", "effectful-local", "effectful-external")
CONFIDENCE = ("high", "medium", "low")
#: Most operations an inventory keeps, by class of repository.
CLASS_LIMITS = {"library": 25, "cli-tool": 60, "service-app": 80}
OTHER_LIMIT = 40


def rank_in(column: str | Column, values: tuple[str, ...]) -> Column:
    """1-based place of a value in a closed list; 0 for others."""
    return F.array_position(F.array(*map(F.lit, values)), F.col(column) if isinstance(column, str) else column)


def fuse_confidence(sources: Column, corroboration: Column, ambiguous: Column, weak: Column, placeholder: Column) -> Column:
    """Confidence from the set of evidence sources; the first rule that holds decides."""
    has = lambda s: F.array_contains(sources, s)
    high = F.when(weak, "medium").otherwise("high")
    return (
        F.when(F.size(sources) == 0, "low").when(F.size(F.array_remove(sources, "proposed")) == 0, "low").when(placeholder, "low")
        .when(has("declared"), F.when(ambiguous, "medium").otherwise(high))
        .when(has("traced") & has("inferred"), F.when(ambiguous, "medium").otherwise(high))
        .when(has("traced"), "medium")
        .when(has("inferred"), F.when(ambiguous, "low").when(corroboration >= 2, high).otherwise("medium"))
        .otherwise("low")
    )


def distinct_evidence(evidence: DataFrame, key: list[str]) -> DataFrame:
    """Evidence rows (key, source, loc, detail, ord) without repeats, as a list by trust, place and first appearance."""
    once = evidence.groupBy(*key, "source", "loc", "detail").agg(F.min("ord").alias("ord"))
    item = F.struct(rank_in("source", SOURCES).alias("rank"), F.coalesce("loc", F.lit("")).alias("at"), "ord", "source", "loc", "detail")
    listed = F.array_sort(F.collect_list(item))
    return once.groupBy(*key).agg(F.transform(listed, lambda e: F.struct(e["source"].alias("source"), e["loc"].alias("loc"), e["detail"].alias("detail"))).alias("evidence"))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order, as a struct minimum: combines on the map side, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]])


def merge_keys(operations: DataFrame, scope: list[str]) -> tuple[DataFrame, list[str]]:
    keyed = operations.withColumn("requires_key", F.array_sort("requires")).withColumn("gate_key", F.array_sort("gate"))
    return keyed, [*scope, "stage", "effect", "requires_key", "gate_key", "optional"]


def merge_operations(operations: DataFrame, scope: list[str]) -> DataFrame:
    """Operations of equal stage, effect, requirements, gates and optional flag become one: the first, and how many they are.

    The first by ``ord`` gives id, name and confidence, not the best; the summary is the first that isn't empty. Which operations
    became which are rows of ``merged_members``, and their evidence rows of ``merged_evidence``: no list grows with a group.
    """
    keyed, keys = merge_keys(operations, scope)
    told = F.when(F.coalesce("summary", F.lit("")) != "", F.col("ord"))
    return keyed.groupBy(*keys).agg(
        F.min_by("id", "ord").alias("id"), F.min_by("confidence", "ord").alias("confidence"), F.min("ord").alias("ord"), F.min_by("summary", told).alias("summary"), F.count("*").alias("n_merged"),
    ).withColumnRenamed("requires_key", "requires").withColumnRenamed("gate_key", "gate")


def merged_members(operations: DataFrame, scope: list[str]) -> DataFrame:
    """scope, merged_id, ord, id: every operation under the one that it became; order by ord."""
    keyed, keys = merge_keys(operations, scope)
    firsts = keyed.groupBy(*keys).agg(F.min_by("id", "ord").alias("merged_id")).select(*[F.col(k).alias(f"_{k}") for k in keys], "merged_id")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]  # stage, effect or the flag may be null: those are equal as well
    return keyed.join(firsts, same).select(*scope, "merged_id", "ord", "id")


def merged_evidence(operations: DataFrame, scope: list[str]) -> DataFrame:
    """scope, merged_id, ord, place, and the fields of ``evidence`` (an array in ``operations``) of all operations that became one.

    Order by ord, then place: the lists follow each other as their operations do.
    """
    items = operations.select(*scope, "id", F.posexplode("evidence").alias("place", "e"))
    return merged_members(operations, scope).join(items, [*scope, "id"]).select(*scope, "merged_id", "ord", "place", "e.*")


def first_places(rows: DataFrame, scope: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` values of ``order`` of each scope as text, and how many more there are: a limit of the feature.

    Every task keeps ``most`` values of a scope, so a scope of any size is one short row for each task.
    """
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(order))
    kept = rows.select(*scope, order).withColumn("_place", place).where(F.col("_place") <= most)
    listed = kept.groupBy(*scope).agg(F.array_sort(F.collect_list(order)).alias("_first"))
    n = rows.groupBy(*scope).agg(F.count("*").alias("_n")).join(listed, scope)
    more = F.when(F.col("_n") > most, F.concat(F.lit(" and "), F.col("_n") - most, F.lit(" more"))).otherwise("")
    return n.select(*scope, F.concat(F.concat_ws(", ", F.col("_first").cast("array<string>")), more).alias("locations"))


def drop_plumbing(operations: DataFrame) -> DataFrame:
    return operations.where((F.size("requires") > 0) | (F.size("gate") > 0))


def cap_by_class(operations: DataFrame, scope: list[str], cls: str) -> DataFrame:
    """The best operations of each scope by confidence and id, as many as its class allows: a limit of the feature."""
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_LIMITS.items() for x in kv]), F.col(cls)), F.lit(OTHER_LIMIT))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(rank_in("confidence", CONFIDENCE), "id"))
    return operations.withColumn("place", place).where(F.col("place") <= limit)


def attention_order(confidence: str = "confidence", gate: str = "gate") -> list[Column]:
    """Sort keys: most uncertain first, gated before ungated, then id."""
    rank = F.when(F.col(confidence) == "low", 0).when(F.col(confidence) == "medium", 1).when(F.col(confidence) == "high", 2).otherwise(3)
    return [rank, F.when(F.size(gate) > 0, 0).otherwise(1), F.col("id")]


def dominant_effect(effect: str, order: str) -> Column:
    """Aggregate: the strongest effect, the first of equals; effectful-external without any."""
    rank = rank_in(effect, EFFECTS)
    return F.coalesce(F.max_by(effect, F.struct(rank, -F.col(order))), F.lit("effectful-external"))


def running_total(rows: DataFrame, scope: list[str], order: str, value: str, width: int = 100_000) -> DataFrame:
    """Running sum of ``value`` in a scope by ``order`` (an integer), in two levels.

    Totals of ranges of ``width`` order values are summed first, then the rows within each range. So no task ever gets a
    whole scope, however large one is; the first level has a row for each range only.
    """
    part = F.floor(F.col(order) / width)
    ranged = rows.withColumn("_range", part)
    totals = ranged.groupBy(*scope, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*scope, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*scope, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(base, [*scope, "_range"]).withColumn("running", F.col("_base") + F.sum(value).over(within)).drop("_range", "_base")
