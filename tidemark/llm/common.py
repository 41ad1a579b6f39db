"""Helpers that every training-data operator shares: text UDFs, samples of labelled rows, and the storage of sources.tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import discard, materialise, new_path
from tidemark.sources.tables import read_texts as read

__all__ = ["crc_mod", "discard", "document_sample", "in_order", "labelled_sample", "materialise", "new_path", "read", "text_udf", "with_struct"]

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def text_udf(fields: dict[str, str], make: Callable[[], Callable[[list], list]], raw: bool = False):
    """An Arrow UDF from one text column to a struct.

    ``make()`` runs once in a task and returns a function from a list of texts (None for null; bytes if ``raw``)
    to one list per field. Marked nondeterministic so that a filter on the result never evaluates it twice.
    """
    types = [ARROW[t] for t in fields.values()]
    names = list(fields)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for batch in batches:
            texts = (batch.cast(pa.binary()) if raw else batch).to_pylist()
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(fn(texts), types, strict=True)], names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<" + ",".join(f"`{k}`:{v}" for k, v in fields.items()) + ">").asNondeterministic()


def with_struct(df: DataFrame, name: str, struct: Column, fields: list[str]) -> DataFrame:
    """Add a struct's fields as columns; a column of the input with the same name (in any case) is replaced."""
    new = {f.lower() for f in fields} | {name.lower()}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    return df.withColumn(name, struct).select(*kept, *[F.col(f"{name}.{f}").alias(f) for f in fields])


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` documents of each label value (0, 1), the ones with the smallest hash of their id.

    Only ids travel to pick the sample (two bounded top-k sorts); the texts are then fetched by a broadcast
    semi-join whose size is bounded by 2 * per_class ids. Rows that repeat an id count once, with their smallest text,
    so what a driver gathers from the sample is bounded too. It is written down, as a fit reads it several times and
    would scan all texts each time.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = F.xxhash64("doc_id")
    picked = [one.where(F.col("label") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return materialise(rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")), "sample")


def document_sample(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, text of the ids of the ``most`` rows with the smallest hash; an id counts once, with its smallest text."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))


def in_order(rows: list) -> list:
    """Rows of a sample by id: a model doesn't depend on how its sample was partitioned."""
    return sorted(rows, key=lambda r: r["doc_id"])
