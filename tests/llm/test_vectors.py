"""Hard negatives, centroid clustering and sharding against brute force, on awkward rows and small blocks."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import AWKWARD, table
from tidemark.llm import hard_negatives, lloyd, sharding, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def vector_rows(n, dims, seed, spread=1.0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(4, dims))
    return [(i, [float(np.float32(x)) for x in base[i % 4] + spread * r.normal(size=dims)], int(r.integers(0, 3)), "x") for i in range(n)]


def awkward_vectors(dims):
    v = [0.5] * dims
    bad = [(900, None, 1, "x"), (901, v, None, "x"), (902, [None, *v[1:]], 1, "x"), (903, [float("nan"), *v[1:]], 1, "x"), (904, [float("inf"), *v[1:]], 1, "x"), (910, v[1:], 1, "x"), (911, [], 1, "x")]
    same = [(920 + i, v, i % 2, "x") for i in range(30)] + [(920, v, 0, "x")] * 2 + [(None, v, 1, "x")]
    return bad + same


def takes_part(v, label=0):
    return v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)


def mined_by_hand(rows, positives, negatives, low, high, every=10):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y, _ in rows if takes_part(v, y)]
    last = float("inf")
    anchors = {}
    for i, v, y in rows:
        if i is not None and i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (y, v) in anchors.items():
        scored = sorted(((-sum(p * q for p, q in zip(v, w, strict=True)), last if i is None else i, z) for i, w, z in rows if len(w) == len(v)), key=lambda t: t[:2])
        for s, p, _ in [t for t in scored if t[2] == y and t[1] != a][:positives]:
            fit = [(n, t) for t, n, z in scored if z != y and low * -s <= 100 * -t <= high * -s]
            out += [(a, None if p == last else p, k, None if n == last else n, -s, -t) for k, (n, t) in enumerate(fit[:negatives], 1)]
    return Counter(out)


@pytest.mark.parametrize(("block", "low", "high"), [(1 << 15, 30, 90), (3, 30, 90), (4, 0, 100), (5, 50, 50)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, low, high):
    monkeypatch.setattr(hard_negatives, "ANCHOR_TILE", 2)
    monkeypatch.setattr(hard_negatives, "ROW_TILE", 7)
    rows = vector_rows(150, 6, 1) + awkward_vectors(6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, 5, 4, low, high, block=block)
    assert Counter(tuple(r) for r in got.collect()) == mined_by_hand(rows, 5, 4, low, high)


def test_hard_negatives_without_rows_or_anchors(spark):
    df = spark.createDataFrame(awkward_vectors(4), SCHEMA)
    for none in (df.where("false"), df.where("vec_id = 901"), df.where("vec_id is null")):
        assert hard_negatives.hard_negatives(none, F.col("vec_id") % 1 == 0).count() == 0


def test_products_are_exact_and_end_at_a_long():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**22, 1.0], [2.0**30, 1.0]])
    assert vectors.products(a, b).tolist() == [[2**62 + 3, 2**63 - 1]]
    assert vectors.products(-a, b).tolist() == [[-(2**62) - 3, -(2**63) + 1]]
    assert vectors.products(np.zeros((1, 0)), np.zeros((2, 0))).tolist() == [[0, 0]]


def test_limits_have_no_rounding():
    scores = np.array([0, 1, 7, 10, 99, 2**62, -5])
    upper, lower = hard_negatives.limits(scores, 30, 90)
    assert upper.tolist() == [90 * s // 100 for s in scores.tolist()[:-1]] + [-1]
    assert lower.tolist() == [-(-30 * s // 100) for s in scores.tolist()[:-1]] + [0]


def clustered_by_hand(rows, k, rounds, dims, scale, salt):
    kept = [(i, [max(-lloyd.END, min(lloyd.END, math.floor(scale * x))) for x in v]) for i, v, _, _ in rows if takes_part(v) and len(v) == dims]
    seeds = {}
    for i, v in kept:
        if i is not None:
            h = hashlib.sha256(f"{salt}{i}".encode()).hexdigest()
            seeds[h] = min(seeds.get(h, v), v)
    cents = [v for _, v in sorted(seeds.items())[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), cents


@pytest.mark.parametrize(("k", "width", "block"), [(8, 16, 4096), (3, 4, 7), (1, 3, 5), (60, 2, 16)])
def test_lloyd_equals_brute_force(spark, monkeypatch, k, width, block):
    monkeypatch.setattr(lloyd, "BLOCK", block)
    rows = vector_rows(40, 6, 2, 0.3) + awkward_vectors(6) + [(930, [1e30] * 6, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got, cents = lloyd.cluster(df, k, 4, 6, width, 1024.0, "3:")
    expected, by_hand = clustered_by_hand(rows, k, 4, 6, 1024.0, "3:")
    assert cents.tolist() == by_hand
    assert Counter(tuple(r) for r in got.collect()) == expected


def test_lloyd_without_vectors(spark):
    df = spark.createDataFrame(awkward_vectors(64), SCHEMA)
    for none in (df.where("false"), df.where("vec_id between 900 and 911 and vec_id <> 901")):
        got, cents = lloyd.cluster(none)
        assert got.count() == 0 and len(cents) == 0


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*AWKWARD, "w " * 20_000, *["copy of a text"] * 40, *[f"text {i}" for i in range(300)]]
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a", None, None, None), (3, "repeated id", "en", "s", 1)] + [(7, "hot", "en", "s", 3)] * 2500, "doc_id long, text string, lang string, source string, n_chars long")
    df = table(spark, texts).unionByName(odd).repartition(6)
    for c in ("shard", "slot", "size", "copies", "position", "bucket", "start", "team", "own", "base"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def drawn_by_hand(key, weights):
    def pull(i):
        h = int(hashlib.md5(":".join([str(i), *([str(key)] if key is not None else [])]).encode()).hexdigest()[:13], 16)
        return weights[i] / -math.log((h + 0.5) / 16**13)

    return max(range(len(weights)), key=lambda i: (pull(i), -i))


@pytest.mark.parametrize("bucket_rows", [50_000, 20])
def test_shards_equal_brute_force_and_slots_have_no_gaps(spark, docs, bucket_rows):
    weights, more = [1.0, 2.0, 0.5, 1.0], [1.5]
    got = sharding.shard_records(docs, weights, more, bucket_rows=bucket_rows).collect()
    rows = docs.select("doc_id", "text").collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    for r in got:
        assert r["shard"] == drawn_by_hand(r["doc_id"], weights) and r["grown_shard"] == drawn_by_hand(r["doc_id"], weights + more)
        assert r["grown_shard"] in (r["shard"], 4)
    for shard in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_slots_do_not_depend_on_buckets(spark, docs):
    a, b = (sorted(map(str, sharding.shard_records(docs, [1.0] * 3, bucket_rows=n).collect())) for n in (50_000, 10))
    assert a == b


def test_weights_and_growth(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    weights = [1.0, 2.0, 3.0, 4.0]
    shard = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard_records(keys, weights, [10.0]).collect()}
    share = Counter(s for s, _ in shard.values())
    assert all(abs(share[i] / 20_000 - w / 10) < 0.02 for i, w in enumerate(weights))
    assert abs(sum(g == 4 for _, g in shard.values()) / 20_000 - 0.5) < 0.02
    heavier = {r["doc_id"]: r["shard"] for r in sharding.shard_records(keys, [1.0, 2.0, 3.0, 5.0]).collect()}
    assert all(heavier[k] in (s, 3) for k, (s, _) in shard.items())
    with pytest.raises(ValueError, match="positive"):
        sharding.rendezvous(["doc_id"], [1.0, 0.0])


def test_no_python_and_no_text_in_the_shuffles(spark, docs):
    plan = sharding.shard_records(docs, [1.0] * 16, [1.0])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text#" not in plan
    assert sharding.shard_records(docs.where("false"), [1.0] * 16).count() == 0
