"""Best-fit packing into bins of several permitted capacities.

Documents are dealt into shards of bounded size by a hash; a shard is packed in one task from (id, length) alone, texts
never travel. Within a shard, pieces go by decreasing length into the open bin that they fill best. Where none fits, a
bin is opened whose capacity has the least cost for the piece: its cost, shared in proportion with the shorter pieces
that can still fill it. The capacities are optimised jointly: packings that open no bin larger than each permitted
length in turn (larger pieces excepted) are all made, and the one of least total cost stays, after every bin has been
downsized to the smallest capacity that holds its contents. The cost of a bin is its capacity plus an attention term.

Documents longer than the largest capacity are cut into pieces of that capacity and a rest.

Defined results: null or non-positive lengths give no piece (a null or empty text has its end token, so op5 has a piece for
every row); very long texts are cut as said; ties go by id, then piece; repeated rows are packed as documents of their own,
and rows of one id and length, however many, are dealt to all shards by their number; an empty table gives no rows; columns
of the input beside doc_id and n_tokens (doc_id and text for token_lengths), whatever their names, are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, read
from tidemark.llm.tokens import byte_bpe, token_counts

CAPACITIES = (512, 1024, 2048, 4096, 8192)
PACKED = "doc_id long, piece int, start long, n_tokens int, bin long, capacity int, offset int"


def cost(capacity: int, attention: float = 1 / 65536) -> float:
    """Of one bin: linear work, and the part of attention that grows with the square of its length."""
    return capacity + attention * capacity * capacity


def best_fit(lengths: list[int], capacities: tuple[int, ...], largest: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each piece (lengths in decreasing order); capacity opened and room used of each bin.

    ``largest`` bounds the capacities that are opened for pieces that fit into it. ``room`` has a bit for each free
    length with an open bin, so the tightest bin for a piece is the lowest bit at or above its length.
    """
    room, free = 0, [[] for _ in range(max(capacities) + 1)]
    bins, offsets, opened, used = [], [], [], []
    left = sum(lengths)
    for n in lengths:
        left -= n
        above = room >> n
        if above:
            gap = n + (above & -above).bit_length() - 1
            b = free[gap].pop()
            if not free[gap]:
                room ^= 1 << gap
            gap -= n
        else:
            usable = [c for c in capacities if c >= n and c <= max(largest, n)] or [min(c for c in capacities if c >= n)]
            size = min(usable, key=lambda c: (cost(c) * n / min(c, n + left), c))
            b = len(opened)
            opened.append(size)
            used.append(0)
            gap = size - n
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if gap:
            free[gap].append(b)
            room |= 1 << gap
    return bins, offsets, opened, used


def downsized(used: list[int], capacities: tuple[int, ...]) -> np.ndarray:
    """The smallest capacity that holds each bin's contents."""
    c = np.sort(np.array(capacities))
    return c[np.searchsorted(c, np.array(used, int))]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], np.ndarray]:
    """Bin and offset of each piece, capacity of each bin: the cheapest of the packings tried."""
    tried = []
    for largest in capacities:
        bins, offsets, _, used = best_fit(lengths, capacities, largest)
        sizes = downsized(used, capacities)
        tried.append((sum(map(cost, sizes.tolist())), largest, bins, offsets, sizes))
    _, _, bins, offsets, sizes = min(tried, key=lambda t: t[:2])
    return bins, offsets, sizes


def pack_documents(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = 4_000_000, shard_rows: int = 200_000) -> DataFrame:
    """Pack rows (doc_id, n_tokens); returns a row for each piece: doc_id, piece, start, n_tokens, bin, capacity, offset.

    ``lengths`` is read twice: once for the totals that set the number of shards, once to deal the rows.
    """
    rows = lengths.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")
    total, count = rows.agg(F.sum("n_tokens"), F.count("*")).first()
    shards = max(1, -(-(total or 0) // shard_tokens), -(-count // shard_rows))
    top = max(capacities)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy(zero_copy_only=False).astype(float if table.column("doc_id").null_count else np.int64)
        n = table.column("n_tokens").to_numpy()
        pieces = -(-n // top)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(top, n[row] - piece * top)
        order = np.lexsort((piece, ids[row], -size))
        row, piece, size = row[order], piece[order], size[order]
        bins, offsets, sizes = pack(size.tolist(), capacities)
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(piece * top, pa.int64()), "n_tokens": pa.array(size, pa.int32()),
            "bin": pa.array((key[0].as_py() << 32) + np.array(bins, np.int64), pa.int64()), "capacity": pa.array(sizes[np.array(bins, int)], pa.int32()), "offset": pa.array(offsets, pa.int32()),
        })

    shard = F.pmod(F.xxhash64("doc_id", "n_tokens", "copy"), F.lit(shards)).alias("shard")
    return numbered(rows).select("doc_id", "n_tokens", shard).groupBy("shard").applyInArrow(run, PACKED)


def numbered(rows: DataFrame, step: int = 1000) -> DataFrame:
    """doc_id, n_tokens, copy: equal rows are counted, on the map side first, and get numbers, so a hash can part them."""
    rows = rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("n"))
    rows = rows.select("doc_id", "n_tokens", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {step}"))).alias("team"))
    return rows.select("doc_id", "n_tokens", F.explode(F.sequence(F.col("team") * step, F.least(F.col("n"), (F.col("team") + 1) * step) - 1)).alias("copy"))


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and number of ids with the end id, written once to the shared folder: counting is the costly part."""
    counts = token_counts(tokenizer_path)
    return materialise(docs.select("doc_id", (counts("text") + 1).alias("n_tokens")), "lengths")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(token_lengths(read(spark, sf_dir, "documents"), byte_bpe()))
