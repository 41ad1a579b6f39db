"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a learned embedding;
learned filters of 16 bytes move over a chunk in steps of 4, their rectified answers are max-pooled over the chunk,
and a small dense layer turns the pooled answers into a chunk's logit. A document's probability combines the mean,
largest and smallest logit of all its chunks by logistic regression, which also sets the level.

Fitted on at most ``per_class`` labelled documents of each label (the smallest hashes of the id), of which one part
trains the network on at most ``chunks_per_doc`` chunks a document and another part the combination, on whole documents.
Scoring covers every byte of every document.

Defined results: null and empty texts are scored as one chunk of padding; very long texts by all their chunks, in blocks of
bounded size; repeated rows and ties get equal scores; without labels of both values the score is the share of label 1 (0.5
without any label); an empty table gives no rows; the score is one column, so other columns, whatever their names, are
left as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, in_order, labelled_sample, read, text_udf

CHUNK, STEP, STRIDE, BLOCKS, DIM, FILTERS, HIDDEN = 512, 448, 4, 4, 8, 32, 16
POOLED = ["mean", "top", "low"]


def chunks_of(text: bytes | None) -> np.ndarray:
    """Overlapping chunks over the whole text, the last one padded with zero bytes."""
    raw = np.frombuffer(text or b"", np.uint8)
    n = max(1, -(-(len(raw) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def start(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    k = STRIDE * DIM
    return {
        "embed": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
        "filters": r.normal(0, (BLOCKS * k) ** -0.5, (BLOCKS, k, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }


def convolve(m: dict[str, np.ndarray], chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, blocks, STRIDE * DIM) embedded bytes and (chunks, places, FILTERS) filter answers."""
    a = m["embed"][chunks].reshape(len(chunks), CHUNK // STRIDE, STRIDE * DIM)
    places = CHUNK // STRIDE - BLOCKS + 1
    z = a[:, :places] @ m["filters"][0]
    for j in range(1, BLOCKS):
        z += a[:, j : j + places] @ m["filters"][j]
    return a, z


def chunk_logits(m: dict[str, np.ndarray], chunks: np.ndarray) -> np.ndarray:
    out = []
    for i in range(0, len(chunks), 32):  # small blocks stay in the processor's cache
        pool = np.maximum(convolve(m, chunks[i : i + 32])[1].max(1) + m["bias"], 0)
        out.append(np.tanh(pool @ m["hidden"] + m["hidden_bias"]) @ m["out"] + m["out_bias"])
    return np.concatenate(out)


def train(chunks: np.ndarray, label: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 2e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the chunks' log loss, both labels drawn alike; max-pooling sends each filter's gradient to one place."""
    m, r = start(seed), np.random.default_rng(seed)
    sides = [np.flatnonzero(label == v) for v in (0, 1)]
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    rows = np.arange(batch)[:, None]
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(s, batch // 2) for s in sides])
        x, y = chunks[pick], label[pick].astype(np.float32)
        a, z = convolve(m, x)
        at = z.argmax(1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0] + m["bias"]
        pool = np.maximum(top, 0)
        h = np.tanh(pool @ m["hidden"] + m["hidden_bias"])
        p = 1 / (1 + np.exp(-(h @ m["out"] + m["out_bias"])))
        d = (p - y) / batch
        dh = d[:, None] * m["out"] * (1 - h * h)
        dp = (dh @ m["hidden"].T) * (top > 0)
        g = {"out": h.T @ d, "out_bias": d.sum(keepdims=True), "hidden": pool.T @ dh, "hidden_bias": dh.sum(0), "bias": dp.sum(0)}
        g["filters"] = np.stack([np.einsum("bfk,bf->kf", a[rows, at + j], dp) for j in range(BLOCKS)])
        de = np.stack([dp[..., None] * m["filters"][j].T for j in range(BLOCKS)], 2).reshape(-1, DIM)
        where = ((at * STRIDE)[..., None] + np.arange(BLOCKS * STRIDE)).reshape(batch, -1)
        ids = np.take_along_axis(x, where, 1).reshape(-1)
        g["embed"] = np.stack([np.bincount(ids, de[:, k], 256) for k in range(DIM)], 1)
        for k, v in g.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.001 * (v * v - second[k])
            m[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def pooled(m: dict[str, np.ndarray], texts: list[bytes | None]) -> np.ndarray:
    """Mean, largest and smallest chunk logit of each text."""
    out = np.zeros((len(texts), len(POOLED)))
    i = 0
    while i < len(texts):
        group, size, j = [], 0, i
        while j < len(texts) and size < 2048:
            group.append(chunks_of(texts[j]))
            size += len(group[-1])
            j += 1
        begin = np.cumsum([0, *map(len, group[:-1])])
        logit = np.concatenate([chunk_logits(m, c) for c in (group if size > 8192 else [np.concatenate(group)])])
        out[i:j, 0] = np.add.reduceat(logit, begin) / [len(g) for g in group]
        out[i:j, 1] = np.maximum.reduceat(logit, begin)
        out[i:j, 2] = np.minimum.reduceat(logit, begin)
        i = j
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int = 3000, chunks_per_doc: int = 6) -> dict:
    """The model: network, combination and the share of label 1, which stands in where a label is missing."""
    shares = {r[label]: r["count"] for r in labels.where(keep & F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return {"share": shares.get(1, 0) / total if total else 0.5}
    sample = labelled_sample(docs, labels, label, keep, per_class).select("doc_id", "label", "text").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)))

    def some(texts: list[bytes | None]) -> list[list]:
        got = [chunks_of(t) for t in texts]
        return [[c[np.linspace(0, len(c) - 1, min(len(c), chunks_per_doc)).astype(int)].tobytes() for c in got]]

    taken = in_order(sample.where("part > 0").select("doc_id", "label", text_udf({"c": "binary"}, lambda: some, raw=True)("text")["c"].alias("c")).collect())
    cut = [np.frombuffer(r["c"], np.uint8).reshape(-1, CHUNK) for r in taken]
    y = np.repeat([r["label"] for r in taken], [len(c) for c in cut])
    if len(set(y.tolist())) < 2:
        return {"share": shares[1] / total}
    m = train(np.concatenate(cut), y)
    rest = in_order(sample.where("part = 0").select("doc_id", "label", pooled_udf(m)("text").alias("p")).select("doc_id", "label", "p.*").collect())
    x, y = np.array([[r[c] for c in POOLED] for r in rest]).reshape(-1, len(POOLED)), np.array([r["label"] for r in rest], int)
    weight = np.array([shares[v] / max(1, (y == v).sum()) for v in (0, 1)])[y.astype(int)] * len(y) / total if len(y) else y
    return {"share": shares[1] / total, "net": m, "combine": logistic(x, y, weight)}


def pooled_udf(m: dict[str, np.ndarray]):
    return text_udf(dict.fromkeys(POOLED, "double"), lambda: lambda texts: list(pooled(m, texts).T), raw=True)


def scorer(model: dict):
    """An Arrow UDF: the probability of label 1."""

    def make():
        def score(texts: list[bytes | None]) -> list:
            if "net" not in model:
                return [[model["share"]] * len(texts)]
            w = model["combine"]
            return [1 / (1 + np.exp(-np.clip(pooled(model["net"], texts) @ w[:-1] + w[-1], -30, 30)))]

        return score

    return lambda text: text_udf({"p": "double"}, make, raw=True)(text)["p"]


def quality_model(docs: DataFrame, labels: DataFrame) -> dict:
    """The quality model; documents whose crc32 of the id is divisible by 5 are never learned from."""
    return fit(docs, labels, "quality", crc_mod("doc_id", 5) > 0)


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_model(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
