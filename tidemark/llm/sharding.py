"""Sharding by weighted rendezvous hashing, with DataFrame functions alone.

Every shard draws a number for every record key, u(key, shard) in (0, 1) from an md5 digest, and the key goes to the shard of
the greatest weight / -ln(u). A shard of weight w gets w of the sum of all weights, in the mean. The draws of a shard don't
depend on the other shards: one more shard takes keys only into itself, one less gives away only its own, and another weight
moves only keys to or from that shard.

Slots number a shard's rows without gaps, by the digest of the whole row, so neighbouring slots are unrelated records. The
number of rows before a row comes in two levels: leading bits of the digest deal each shard into buckets of some
BUCKET_ROWS rows, buckets are counted and summed, and rows are numbered inside their bucket. Equal rows are counted on the
map side first and take consecutive slots, so however many there are they meet as one row.

Defined results: a null text has the size 1 and the checksum 0; a null key is a key like any other (all its rows share a shard,
but not a bucket); whole texts are measured and summed; rows that repeat are records of their own with slots of their own, and
rows that tie in the digest are equal, so their order doesn't matter; weights must be positive; an empty table gives no rows;
columns of the input beside the keys and the text, whatever their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, read

BUCKET_ROWS = 50_000
#: Hexadecimal digits of a digest that make a number: 52 bits, which a double holds exactly.
DIGITS = 13


def digest(*parts: Column) -> Column:
    """The first 52 bits of the md5 of the parts' text, null parts left out, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, DIGITS), 16, 10).cast("long")


def rendezvous(keys: Sequence[str], weights: Sequence[float]) -> Column:
    """The shard (from 0) that a row's keys choose among shards of these weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, and one at least")

    def pull(shard: int, weight: float) -> Column:
        u = (digest(F.lit(f"{shard}"), *[F.col(k) for k in keys]) + 0.5) / F.lit(float(16**DIGITS))
        return F.struct((F.lit(float(weight)) / -F.ln(u)).alias("pull"), F.lit(-shard).alias("turn"))  # a tie goes to the smaller shard

    drawn = [pull(i, w) for i, w in enumerate(weights)]
    return -(F.greatest(*drawn) if len(drawn) > 1 else drawn[0])["turn"]


def numbered(rows: DataFrame, scope: list[str], order: list[str], count: str, position: str, bits: int = 4 * DIGITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with column ``start``: the sum of ``count`` over the rows before it in its scope.

    Order is by ``position``, a hash of ``bits`` bits, then ``order``. Leading bits make buckets of some ``bucket_rows`` rows.
    """
    n = rows.count()
    deep = min(bits, max(0, (max(n, 1) // bucket_rows)).bit_length())
    placed = rows.withColumn("bucket", F.shiftright(position, bits - deep) if deep else F.lit(0).cast("long"))
    before = Window.partitionBy(*scope).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*scope, "bucket").agg(F.sum(count).alias("own")).select(*scope, "bucket", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*scope, "bucket").orderBy(position, *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return placed.join(sums, [*scope, "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("bucket", "base")


def shard_records(docs: DataFrame, weights: Sequence[float], more: Sequence[float] = (), keys: Sequence[str] = ("doc_id",), text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """keys, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot and grown_shard for every row of ``docs``.

    ``grown_shard`` is the row's shard when shards of the weights ``more`` are added; null if there are none. Texts are read
    once and don't travel; two shuffles move keys and numbers only.
    """
    keys = list(keys)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keys, (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))
    grown = rendezvous(keys, [*weights, *more]) if more else F.lit(None).cast("int")
    rows = rows.select("*", rendezvous(keys, weights).alias("shard"), grown.alias("grown_shard"), digest(*[F.col(c) for c in (*keys, "size", "text_crc32")]).alias("position"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))  # draws are made where the texts are read
    rows = materialise(rows, "sharded")
    rows = numbered(rows, ["shard"], [*keys, "size", "text_crc32"], "copies", "position", bucket_rows=bucket_rows)
    return each_copy(rows).select(*keys, "size", "text_crc32", "shard", "slot", "grown_shard")


def each_copy(rows: DataFrame, step: int = 1000) -> DataFrame:
    """A row for each of ``copies``, with its slot; in two levels, so that no array holds more than a part of many copies."""
    teams = rows.withColumn("team", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {step}"))))
    own = F.sequence(F.col("team") * step, F.least(F.col("copies"), (F.col("team") + 1) * step) - 1)
    return teams.withColumn("slot", F.explode(own)).withColumn("slot", F.col("slot") + F.col("start"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards by their id; grown_shard with a seventeenth."""
    placed = shard_records(read(spark, sf_dir, "documents"), [1.0] * 16, more=[1.0])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_sql(shards: int = 16) -> str:
    """The same draws, with checksums made bit by bit from the polynomial."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = "i"
    for _ in range(8):
        crc = f"(SELECT {step} FROM (SELECT {crc} AS c))"

    def choice(n: int) -> str:
        draws = ", ".join(f"-1.0 / ln((CAST('0x' || substr(md5(concat_ws(':', '{s}', doc_id)), 1, {DIGITS}) AS BIGINT) + 0.5) / {float(16**DIGITS)})" for s in range(n))
        return f"(SELECT CAST(list_position(d, list_max(d)) - 1 AS INTEGER) FROM (SELECT [{draws}] AS d))"

    return rf"""
WITH bytes AS (SELECT range AS i, {crc} AS entry FROM range(256)),
entries AS (SELECT list(entry ORDER BY i) AS t FROM bytes),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
s AS (
  SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size,
    CAST(xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS BIGINT) AS text_crc32 FROM b, entries),
p AS (
  SELECT *, {choice(shards)} AS shard, {choice(shards + 1)} AS grown_shard,
    CAST('0x' || substr(md5(concat_ws(':', doc_id, size, text_crc32)), 1, {DIGITS}) AS BIGINT) AS position FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY position, doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM p
"""


OP13_SQL = op13_sql()
