"""Hard-negative mining by slots of scores.

Anchors come in blocks of a bounded number; for each block two passes over all rows follow, so a pass holds the block alone,
whatever the table. The first pass keeps each anchor's best rows of its own label, its positives. A positive of score s
admits negatives from low * s to high * s percent; these windows overlap, but their upper limits, descending, split the
scores into disjoint slots. In the second pass every task keeps the best k of each slot (a combiner: what is shuffled is at
most k rows for each task, anchor and slot, whatever a label holds), and these are reduced to the best k of each slot. The
best of a window are then the first k of its own slot followed by all lower ones: a merge of suffixes from the lowest slot
up answers all windows, and each is cut at its lower limit.

Scores are exact inner products of whole numbers. The work grows with anchors times rows; no pair is ever a row.

Defined results: rows with a null label or vector, or with a null or non-finite component, take no part; vectors of different
lengths have no score with each other (empty vectors have the score 0); scores beyond a long are its ends; ties go to the
smaller id, a null id last; null ids are never anchors; rows that repeat an id count each, except that an anchor is one row
for an id (of the smallest label, then vector) and no row of its id is its positive; a positive of a negative score has no
negatives; an empty table, or one without anchors, gives no rows; columns of the input beside the three, whatever their names,
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import discard, materialise, new_path, read
from tidemark.llm.vectors import finite, matrices, products

MIN = -(2**63)
#: Stands for a null id, which is last among ties.
NO_ID = 2**63 - 1
ANCHOR_TILE, ROW_TILE = 256, 4096
FOUND = "anchor_id long, slot int, score long, id long"


class Best:
    """The best k (score, id) of each of n groups: greater scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), MIN), np.full((n, k), NO_ID)

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of a tile (a row for each group, a column for each id), of which ``allowed`` count."""
        allowed = allowed & (score >= self.score[group, -1][:, None])
        if score.shape[1] > 4 * self.k:
            least = np.partition(np.where(allowed, score, MIN), -self.k, axis=1)[:, -self.k]
            allowed &= score >= least[:, None]
        row, column = np.nonzero(allowed)
        if not len(row):
            return
        touched = np.unique(group[row])
        g = np.concatenate([group[row], np.repeat(touched, self.k)])
        s = np.concatenate([score[row, column], self.score[touched].ravel()])
        i = np.concatenate([ids[column], self.id[touched].ravel()])
        order = np.lexsort((i, ~s, g))
        g, s, i = g[order], s[order], i[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
        kept = rank < self.k
        self.score[g[kept], rank[kept]], self.id[g[kept], rank[kept]] = s[kept], i[kept]


def tiles(anchors: dict, batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor positions, row ids, row labels and scores of tiles of anchors and rows of equal vector lengths."""
    ids = batch.column("vec_id").fill_null(NO_ID).to_numpy()
    labels = batch.column("label").to_numpy()
    for at, matrix in matrices(batch.column("vector"), scale):
        own, vectors = anchors["vectors"].get(matrix.shape[1], (None, None))
        if own is None:
            continue
        for r in range(0, len(at), ROW_TILE):
            rows = at[r : r + ROW_TILE]
            for a in range(0, len(own), ANCHOR_TILE):
                yield own[a : a + ANCHOR_TILE], ids[rows], labels[rows], products(vectors[a : a + ANCHOR_TILE], matrix[r : r + ROW_TILE])


def found(anchors: dict, best: Best, slots: int) -> pa.RecordBatch:
    group, rank = np.nonzero(best.score > MIN)
    columns = [anchors["id"][group // slots], (group % slots).astype(np.int32), best.score[group, rank], best.id[group, rank]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "slot", "score", "id"])


def positives_of(rows: DataFrame, shared, scale: float, k: int) -> DataFrame:
    """anchor_id, rank (from 1), score, id of each anchor's best k other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best = Best(len(anchors["id"]), k)
        for batch in batches:
            for own, ids, labels, score in tiles(anchors, batch, scale):
                best.offer(own, score, ids, (anchors["label"][own][:, None] == labels) & (anchors["id"][own][:, None] != ids))
        yield found(anchors, best, 1)

    return first_of(rows.mapInArrow(run, FOUND), ["anchor_id"], k)


def slotted_of(rows: DataFrame, shared, scale: float, k: int) -> DataFrame:
    """anchor_id, slot, rank, score, id of each anchor's best k rows of other labels in each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        upper, lower = anchors["upper"], anchors["lower"]
        slots = upper.shape[1]
        floor = np.maximum(lower, np.c_[upper[:, 1:] + 1, np.full(len(upper), MIN)])  # a slot ends above the next limit
        best = Best(len(upper) * slots, k)
        for batch in batches:
            for own, ids, labels, score in tiles(anchors, batch, scale):
                other = anchors["label"][own][:, None] != labels
                for j in range(slots):
                    inside = other & (score <= upper[own, j][:, None]) & (score >= floor[own, j][:, None])
                    best.offer(own * slots + j, score, ids, inside)
        yield found(anchors, best, slots)

    return first_of(rows.mapInArrow(run, FOUND), ["anchor_id", "slot"], k)


def first_of(rows: DataFrame, scope: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*scope).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def limits(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and least score that positives of these scores admit, without overflow; none for negative scores."""
    whole, rest = scores // 100, scores % 100
    upper, lower = whole * high + rest * high // 100, whole * low - (-rest * low) // 100
    return np.where(scores < 0, -1, upper), np.where(scores < 0, 0, lower)


def windows(slotted: DataFrame, positives: DataFrame, slots: int, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, rank, negative_id, negative_score from the best of the slots."""
    item = F.struct("slot", "rank", "score", "id")
    kept = slotted.groupBy("anchor_id").agg(F.sort_array(F.collect_list(item)).alias("kept"))  # at most slots * k
    suffix: Column = F.slice("kept", 1, 0)
    suffixes = []
    for j in reversed(range(slots)):
        suffix = F.slice(F.concat(F.expr(f"filter(kept, x -> x.slot = {j})"), suffix), 1, k)
        suffixes.insert(0, suffix)
    merged = kept.select("anchor_id", F.array(*suffixes).alias("suffixes"))
    answers = positives.join(merged, "anchor_id").withColumn("own", F.expr("filter(element_at(suffixes, slot + 1), x -> x.score >= lower)"))
    rows = answers.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode("own").alias("at", "x"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select("anchor_id", named("positive_id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score")) \
        .withColumn("negative_id", named("negative_id"))


def anchor_block(table: pa.Table, scale: float) -> dict:
    vectors = {m.shape[1]: (at, m) for at, m in matrices(table.column("vector"), scale)} if len(table) else {}
    return {"id": table.column("vec_id").to_numpy(), "label": table.column("label").to_numpy(), "vectors": vectors}


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, block: int = 1 << 15) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores for the rows (vec_id, label, embedding) where ``anchor`` holds.

    ``block`` anchors, some 400 bytes and 850 of results each, are held by driver and tasks at a time.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("label").isNotNull() & finite("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    chosen = rows.where(anchor & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")
    chosen = materialise(chosen, "anchors")
    blocks = -(-chosen.count() // block)
    path, schema = new_path(spark, "negatives"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not blocks:
        return spark.createDataFrame([], schema)
    for b in range(blocks):
        anchors = anchor_block(chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow(), scale)
        if not len(anchors["id"]):
            continue
        shared = spark.sparkContext.broadcast(anchors)
        near = materialise(positives_of(rows, shared, scale, positives), "positives")
        shared.unpersist()
        top = near.select("anchor_id", "rank", "score").toArrow()
        place = {a: i for i, a in enumerate(anchors["id"].tolist())}
        score = np.full((len(place), positives), -1)
        score[[place[a] for a in top.column("anchor_id").to_pylist()], top.column("rank").to_numpy() - 1] = top.column("score").to_numpy()
        anchors["upper"], anchors["lower"] = limits(score, low, high)
        shared = spark.sparkContext.broadcast(anchors)
        lower = F.expr(f"score div 100 * {low} + (score % 100 * {low} + 99) div 100")
        windowed = near.where("score >= 0").withColumn("slot", F.col("rank") - 1).withColumn("lower", lower)
        windows(slotted_of(rows, shared, scale, negatives), windowed, positives, negatives).write.mode("append").parquet(path)
        shared.unpersist()
        discard(near)
    return spark.read.schema(schema).parquet(path)


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh id moves to the next of ten labels, so that near vectors of another label exist."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: every row whose id is divisible by 100, against all rows."""
    rows = relabelled(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""
