"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark item; an item of fewer words, but
not none, is one shorter window. For each window length L the matcher keeps the Wu-Manber tables with a block
of two words (one word where L is 1): SHIFT says how far the search may jump from a block (L - B + 1 when the
block is in no pattern), suffix buckets select the patterns that end in a block of shift 0, and a direct
comparison of the words confirms an occurrence. Every occurrence covers a block at a multiple of L - B + 1,
so the first probes are those positions alone; numpy looks all of them up at once and the ordinary
shift-by-shift search goes on only around a probe whose block is in the table.

Defined results: null, empty or wordless texts have n_words 0, n_hit 0 and are not contaminated; whole texts are searched,
in memory that grows with the one text; null items and items without words are never found; items with equal windows are all
reported, which settles ties; repeated rows give repeated results; an empty table gives no rows, an empty benchmark no hits;
of other columns of the input those that are added replace theirs, in any case, and the rest stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, new_path, read, text_udf, with_struct

#: Word characters after lower-casing: digits, a-z, all that isn't ASCII. Others become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FIELDS = {"n_words": "long", "n_hit": "long", "hit_starts": "array<int>", "hit_ends": "array<int>", "items": "array<string>"}
NO_RANGES = "cast(array() as array<struct<s:int,e:int>>)"


def words_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(FOLD).split()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.int64(-7046029254386353131) + b
    return h ^ (h >> np.int64(31))


class Matcher:
    """Wu-Manber tables for the patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.stride = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.suffix: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[int]]]] = {}
        for p, items in patterns.items():
            for j in range(self.stride):
                b = p[j : j + self.block]
                self.shift[b] = min(self.shift.get(b, self.stride), self.stride - 1 - j)
            self.suffix.setdefault(p[-self.block :], []).append((p, items))
        blocks = np.array([[hash(w) for w in b] for b in self.shift], np.int64).reshape(-1, self.block)
        keys = blocks[:, 0] if self.block == 1 else mix(blocks[:, 0], blocks[:, 1])
        self.bits = np.zeros(1 << 20, bool)
        self.bits[keys & 0xFFFFF] = True

    def find(self, words: list[bytes], hits: list[tuple[int, int]], items: set[int]) -> None:
        n, size, step, tail = len(words), self.block, self.stride, self.length - self.block
        if n < self.length:
            return
        first = words[0 : n - size + 1 : step]
        key = np.fromiter(map(hash, first), np.int64, len(first))
        if size == 2:
            key = mix(key, np.fromiter(map(hash, words[1::step]), np.int64, len(first)))
        done = -1
        for probe in (np.flatnonzero(self.bits[key & 0xFFFFF]) * step).tolist():
            at, last = max(probe, done + 1), min(probe + tail, n - size)
            while at <= last:
                b = tuple(words[at : at + size])
                move = self.shift.get(b, step)
                if move == 0:
                    start = at - tail
                    if start >= 0:
                        here = tuple(words[start : start + self.length])
                        for p, found in self.suffix[b]:
                            if p == here:
                                hits.append((start, start + self.length))
                                items.update(found)
                    move = 1
                at += move
            done = max(done, last)


class Search:
    """Matchers for all window lengths; made once in a task from (item name, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in items]
        by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for k, (_, text) in enumerate(items):
            w = words_of(text.encode())
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                owners = by_length.setdefault(size, {}).setdefault(tuple(w[i : i + size]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.matchers = [Matcher(size, p) for size, p in sorted(by_length.items())]

    def __call__(self, texts: list[bytes | None]) -> list[list]:
        out: list[list] = [[] for _ in FIELDS]
        for text in texts:
            words = words_of(text)
            hits: list[tuple[int, int]] = []
            items: set[int] = set()
            for m in self.matchers:
                m.find(words, hits, items)
            spans = merged(hits)
            row = (len(words), sum(e - s for s, e in spans), [s for s, _ in spans], [e for _, e in spans], sorted({self.names[i] for i in items}))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open word ranges, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(hits):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_chars: int = 8_000_000) -> DataFrame:
    """Add n_words, n_hit, hit_starts, hit_ends, items and contaminated to every row of ``docs`` (text column ``text``).

    The benchmark is a stated query set. One of at most ``block_chars`` characters goes to every task as it is. A larger one
    is written to the shared folder in blocks of about that size, never through the driver, and searched block by block: a task
    holds the tables of one block alone (of one item at least).
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    if blocks <= 1:
        known = [tuple(r) for r in items.collect()]  # at most block_chars characters
        found = with_struct(docs, "_hits", text_udf(FIELDS, lambda: Search(known, window), raw=True)("text"), list(FIELDS))
    else:
        found = search_blocks(docs, items, blocks, window)
    return with_struct(found, "_flag", F.struct(((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")), ["contaminated"])


def search_blocks(docs: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """Hits of all blocks for each row of ``docs``; what one block finds is written before the next is searched.

    Hits belong to a text, not to a row, so they are kept under the text's digest, once for all its copies.
    """
    from tidemark.llm.tokens import filesystem

    folder = new_path(docs.sparkSession, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).repartition(F.col("block")).write.partitionBy("block").parquet(folder)

    def block(k: int):
        def make():
            from pyarrow import fs, parquet

            store, root = filesystem(f"{folder}/block={k}")
            if store.get_file_info(root).type == fs.FileType.NotFound:
                return Search([], window)
            rows = parquet.read_table(root, columns=["item_id", "text"], filesystem=store, partitioning=None).to_pylist()
            return Search([(r["item_id"], r["text"]) for r in rows], window)

        return text_udf(FIELDS, make, raw=True)

    found = []
    for k in range(blocks):
        hits = docs.where("text is not null").select("text", block(k)("text").alias("h")).where(F.size("h.hit_starts") > 0)
        hits = hits.groupBy(F.sha2("text", 256).alias("_digest")).agg(F.first("h").alias("h"))
        found.append(materialise(hits.select("_digest", "h.hit_starts", "h.hit_ends", "h.items"), "hits"))
    united = found[0]
    for more in found[1:]:
        united = united.unionByName(more)
    ranges = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("hit_starts").alias("s"), F.col("hit_ends").alias("e")))))
    united = united.groupBy("_digest").agg(union_of(ranges).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    counted = text_udf({"n": "long"}, lambda: lambda texts: [[len(words_of(t)) for t in texts]], raw=True)
    rows = docs.withColumn("_count", counted("text")).withColumn("_digest", F.sha2("text", 256)).join(united, "_digest", "left")
    spans = F.coalesce(F.col("_spans"), F.expr(NO_RANGES))
    hits = F.struct(
        F.col("_count.n").alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("n_hit"),
        F.transform(spans, lambda x: x["s"]).alias("hit_starts"),
        F.transform(spans, lambda x: x["e"]).alias("hit_ends"),
        F.coalesce(F.col("_items"), F.expr("cast(array() as array<string>)")).alias("items"),
    )
    return with_struct(rows, "_hits", hits, list(FIELDS)).drop("_digest", "_count", "_spans", "_items")


def union_of(ranges: Column) -> Column:
    """Union of sorted half-open ranges (s, e)."""
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (last(acc)["e"] >= x["s"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e")))),
    ).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))
    return F.aggregate(ranges, F.expr(NO_RANGES), step)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
  FROM bw, LATERAL unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM dw, sizes, LATERAL unnest(generate_series(1, len(w) - size + 1)) AS t(i)),
occ AS (SELECT doc_id, p.size, i, item_id FROM pos p JOIN win USING (size, phrase)),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM occ, LATERAL unnest(generate_series(0, size - 1)) AS t(k) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN names USING (doc_id)
"""
