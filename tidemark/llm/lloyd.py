"""Centroid clustering: Lloyd's rounds over shards of dimensions.

Vectors are laid out once, in blocks of some thousand vectors cut into shards of ``width`` dimensions: a row of the layout is
one block's slice in one shard. A round has two steps. Every task takes slices, of whatever shards, and the centroids' slices of
the same shards, and gives exact partial distances, a packed matrix a slice; a reduction by block adds the shards' matrices
and takes the least of each vector (ties: the smaller number), which is written down. Then the slices meet their block's
assignment, every task adds its slices to sums by shard and cluster, and the sums of a shard give its own slice of the
new centroids. The layout is bucketed by block, so only assignments (a few bytes a vector) travel in the second step.

The driver sees the centroids alone, of k times the dimension, and counts by cluster. Assignments of a finished round are deleted
once the next ones are written; everything else is read from shared folders, so a lost executor costs its tasks.

Components are whole numbers, floor(scale * component), kept within +-2**27, so that distances fit a long: a component
beyond is its nearest end.

Defined results: vectors that are null, of another length, or with a null or non-finite component take no part; rows that
repeat an id count each; a null id is clustered but starts no centroid; with fewer than k vectors (an id counts once) there are
fewer centroids; equal hashes don't arise between ids, and rows of one id start with the smallest vector; empty clusters keep
their centroid; an empty table gives no rows; columns of the input beside vec_id and embedding, whatever their names, are not
carried.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise, new_path, read
from tidemark.llm.vectors import finite, matrices

BLOCK = 4096
END = 2**27
BUCKET_BYTES = 128 << 20
SLICES = "block long, shard int, n int, slice binary"
ASSIGNED = "block long, cluster binary, distance binary"


def layout(rows: DataFrame, dims: int, width: int, scale: float) -> DataFrame:
    """Rows (vec_id, vector) as slices; a block's ids stand with its first shard."""
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("n", pa.int32()), ("slice", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for table in regrouped(batches, BLOCK):
            (_, matrix), = matrices(table.column("vector"), scale)
            matrix = np.clip(matrix, -END, END).astype("<i4")
            shards = range(-(-dims // width))
            parts = [np.ascontiguousarray(matrix[:, s * width : (s + 1) * width]).tobytes() for s in shards]
            ids = [table.column("vec_id").to_pylist() if s == 0 else None for s in shards]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int64()), pa.array(shards, pa.int32()), pa.array([len(table)] * len(parts), pa.int32()), pa.array(parts, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], schema=schema)
            block += 1

    return rows.mapInArrow(run, f"{SLICES}, ids array<long>")


def regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The same rows in tables of ``size`` rows, the last of fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - sum(b.num_rows for b in held))
            held.append(part)
            batch = batch.slice(part.num_rows)
            if sum(b.num_rows for b in held) == size:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def bucketed(slices: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """The slices in a table of the shared folder, bucketed by block; and the table's name."""
    spark, name = slices.sparkSession, f"slices_{uuid.uuid4().hex}"
    slices.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", new_path(spark, "slices")).saveAsTable(name)
    return spark.table(name), name


def assigned(slices: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """block, cluster and distance of its vectors (packed): partial distances by slice, added by block."""
    k = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, part in zip(batch.column("shard").to_pylist(), batch.column("slice"), strict=True):
                own = centroids[:, shard * width : (shard + 1) * width]
                x = np.frombuffer(part.as_buffer(), "<i4").reshape(-1, own.shape[1]).astype(np.int64)
                out.append(np.stack([np.square(x - c).sum(axis=1) for c in own]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "partial"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_buffer(), "<i8") for p in table.column("partial")).reshape(k, -1)
        cluster = total.argmin(axis=0)
        distance = total[cluster, np.arange(total.shape[1])]
        return pa.table({"block": table.column("block")[:1], "cluster": pa.array([cluster.astype("<i4").tobytes()], pa.binary()), "distance": pa.array([distance.astype("<i8").tobytes()], pa.binary())})

    parts = slices.select("block", "shard", "slice").mapInArrow(partial, "block long, partial binary")
    return parts.groupBy("block").applyInArrow(add, ASSIGNED)


def sums(slices: DataFrame, clusters: DataFrame, k: int, width: int) -> DataFrame:
    """shard, cluster, count and the sums of its dimensions (an array), over all slices; each task adds its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, part, chosen in zip(batch.column("shard").to_pylist(), batch.column("slice"), batch.column("cluster"), strict=True):
                cluster = np.frombuffer(chosen.as_buffer(), "<i4")
                x = np.frombuffer(part.as_buffer(), "<i4").reshape(len(cluster), -1).astype(np.int64)
                own = total.setdefault(shard, np.zeros((k, x.shape[1] + 1), np.int64))
                for c in np.unique(cluster).tolist():
                    own[c] += np.r_[(cluster == c).sum(), x[cluster == c].sum(axis=0)]
        rows = [(shard, c, d - 1, int(own[c, d])) for shard, own in sorted(total.items()) for c in range(k) if own[c, 0] for d in range(own.shape[1])]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["shard", "cluster", "dim", "sum"])

    met = slices.select("block", "shard", "slice").join(clusters.select("block", "cluster"), "block").drop("block")
    return met.mapInArrow(run, "shard int, cluster int, dim int, sum long").groupBy("shard", "cluster", "dim").agg(F.sum("sum").alias("sum"))


def moved(centroids: np.ndarray, rows: list, width: int) -> np.ndarray:
    """Every shard's slice of the centroids, floor(sum / count); clusters without vectors stay. dim -1 has the count."""
    out, count = centroids.copy(), {(r["shard"], r["cluster"]): r["sum"] for r in rows if r["dim"] == -1}
    for r in rows:
        if r["dim"] >= 0:
            out[r["cluster"], r["shard"] * width + r["dim"]] = r["sum"] // count[r["shard"], r["cluster"]]
    return out


def first_centroids(rows: DataFrame, k: int, scale: float, salt: str) -> np.ndarray:
    """The vectors of the k ids of smallest hash, in that order."""
    named = rows.where("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
    one = named.orderBy("hash", "vector").limit(k)  # of k rows at most
    ids = [r["hash"] for r in one.select("hash").distinct().collect()]
    if len(ids) < k:  # an id repeats among them
        one = named.groupBy("hash").agg(F.min("vector").alias("vector")).orderBy("hash").limit(k)
    picked = one.orderBy("hash").collect()
    return np.array([np.clip(np.floor(np.array(r["vector"]) * scale), -END, END) for r in picked]).astype(np.int64)


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, width: int = 16, scale: float = 1024.0, salt: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) for every vector that takes part, and the centroids after all rounds."""
    spark = rows.sparkSession
    kept = rows.where((F.size("embedding") == dims) & finite("embedding"))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    centroids = first_centroids(kept, k, scale, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    whole = materialise(layout(kept, dims, width, scale), "layout")
    blocks = whole.where("shard = 0").agg(F.count("*")).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * BLOCK * dims * 4 // BUCKET_BYTES)
    slices, name = bucketed(whole.drop("ids"), min(buckets, max(1, blocks)))
    last = None
    for r in range(rounds + 1):
        now = materialise(assigned(slices, centroids, width), "assigned")
        if last is not None:
            discard(last)
        last = now
        if r < rounds:
            centroids = moved(centroids, sums(slices, now, len(centroids), width).collect(), width)  # k rows a dimension
    spark.sql(f"DROP TABLE {name}")
    discard(slices)
    return vectors_of(whole, last), centroids


def vectors_of(whole: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row for each vector: its id, cluster and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, chosen, distance in zip(batch.column("ids"), batch.column("cluster"), batch.column("distance"), strict=True):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(chosen.as_buffer(), "<i4")), pa.array(np.frombuffer(distance.as_buffer(), "<i8"))], ["vec_id", "cluster", "distance"])

    rows = whole.where("shard = 0").select("block", "ids").join(clusters, "block").drop("block")
    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, centroids = cluster(read(spark, sf_dir, "embeddings"))
    inertia = vectors.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = F.expr("sum(cluster_inertia) over (partition by 1)")  # over a row for each cluster
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    name = F.element_at(F.array(*map(F.lit, [*names, ""])), F.col("cluster") + 1)
    stats = inertia.select("cluster", "cluster_inertia", total.alias("inertia"), name.alias("centroid_sha256"))
    return vectors.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds unrolled; components stand in rows (r: the vector, i: the dimension)."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"d{n} AS MATERIALIZED (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM v JOIN c{n} USING (i) GROUP BY r, c)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            steps.append(f"s{n} AS MATERIALIZED (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS m FROM v JOIN a{n} USING (r) GROUP BY c, i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN m IS NULL THEN y ELSE (s - ((s % m) + m) % m) // m END AS y FROM c{n} LEFT JOIN s{n} USING (c, i))")
    return rf"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM e, LATERAL unnest(generate_series(1, 64)) AS g(i)),
seed AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM e QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {k}),
c0 AS MATERIALIZED (SELECT c, i, x AS y FROM v JOIN seed USING (r)),
{", ".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c),
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN t USING (c) JOIN h USING (c)
"""


OP12_SQL = op12_sql()
