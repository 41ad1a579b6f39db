"""Differences between inventories, merging of a reviewed one, proposals, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("stage", "effect", "requires", "gate", "optional", "confidence", "stand_in")


def text_of(column: Column, kind: str) -> Column:
    return F.concat_ws(",", column) if kind.startswith("array") else column.cast("string")


def diff(old: DataFrame, new: DataFrame, key: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows (key, change, field, old, new): added and removed keys, and each field that changed. Array order counts."""
    kinds = dict(old.dtypes)
    a, b = old.select(*key, F.struct(*fields).alias("a")), new.select(*key, F.struct(*fields).alias("b"))
    both = a.join(b, key, "full_outer")
    null = F.lit(None).cast("string")
    entry = lambda change, field, x, y: F.struct(F.lit(change).alias("change"), field.alias("field"), x.alias("old"), y.alias("new"))
    changed = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), entry("changed", F.lit(f), text_of(F.col(f"a.{f}"), kinds[f]), text_of(F.col(f"b.{f}"), kinds[f]))) for f in fields]
    found = F.when(F.col("a").isNull(), F.array(entry("added", null, null, null))).when(F.col("b").isNull(), F.array(entry("removed", null, null, null))).otherwise(F.array_compact(F.array(*changed)))
    return both.select(*key, F.explode(found).alias("x")).select(*key, "x.*")


def merge_reviewed(draft: DataFrame, reviewed: DataFrame, key: list[str], locs: str, fields: list[str]) -> DataFrame:
    """The draft with the reviewed values of operations whose set of evidence places is unchanged; plus a status column.

    status: kept (reviewed values stay), changed (evidence moved: the draft's values win), new; disappeared operations
    come as rows with the reviewed values.
    """
    d = draft.select(*key, F.struct(locs, *fields).alias("d"))
    r = reviewed.select(*key, F.struct(locs, *fields).alias("r"))
    same = F.array_sort(F.array_distinct(F.col(f"d.{locs}"))).eqNullSafe(F.array_sort(F.array_distinct(F.col(f"r.{locs}"))))
    status = F.when(F.col("r").isNull(), "new").when(F.col("d").isNull(), "disappeared").when(same, "kept").otherwise("changed")
    take = F.when(F.col("status").isin("new", "changed"), F.col("d")).otherwise(F.col("r"))
    return d.join(r, key, "full_outer").withColumn("status", status).withColumn("x", take).select(*key, "status", *[F.col(f"x.{f}").alias(f) for f in fields])


def apply_proposals(operations: DataFrame, proposals: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Union proposed requirements and gates into operations, at low confidence; and the proposals for unknown operations."""
    flat = lambda c: F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))
    asked = proposals.groupBy(*key).agg(flat("requires").alias("more_requires"), flat("gate").alias("more_gate"))
    joined = operations.join(asked, key, "left")
    union = lambda a, b: F.array_sort(F.array_union(a, b))
    touched = F.col("more_requires").isNotNull()
    out = joined.withColumn("requires", F.when(touched, union("requires", "more_requires")).otherwise(F.col("requires")))
    out = out.withColumn("gate", F.when(touched, union("gate", "more_gate")).otherwise(F.col("gate"))).withColumn("confidence", F.when(touched, "low").otherwise(F.col("confidence")))
    return out.drop("more_requires", "more_gate"), proposals.join(operations.select(*key), key, "left_anti")


def digest(operations: DataFrame) -> DataFrame:
    """What may leave: ids, classes and evidence sources, no text of the repository."""
    return operations.select("id", "stage", "effect", "requires", "gate", "confidence", F.array_sort(F.array_distinct("sources")).alias("sources"))
