"""Personal data: candidate spans scored by gradient-boosted trees.

The base patterns (email, ip, card, phone) give spans that always stay. Beside them, high-recall generators propose
overlapping candidates: digit groups of any punctuation, spelled-out addresses, account numbers and identity numbers.
Boosted trees score each candidate from its format (digits, separators, group lengths, check digits) and context (words
and characters beside it); a threshold for each kind, calibrated on examples held out from the trees so that precision
there is at least ``precision``, selects redactions. Of overlapping candidates the likeliest stays; base spans win.

Training: all candidates of all documents, labelled by whether a base span covers them, and made examples in which such data
appear in other dress (other separators, spelled out) or in which numbers are no personal data (amounts, dates, versions,
measures, order numbers). Nothing is drawn; weights keep the balance: a document's candidates weigh as much as ``per_document``
together where there are more, and a larger corpus as much as ``documents`` documents. Features are whole numbers of a byte, so
candidates of equal features are one row with its counts (a cell). Trees grow from sums of gradients by node, feature and value,
and thresholds come from sums by score; up to ``gathered`` cells are summed by the driver, more by Spark, with equal results, as
gradients are rounded to whole numbers whose sums don't depend on their order. The seed is fixed.

Defined results: null and empty texts have no spans; whole texts are scanned, in time linear in their length but for a sort of
the candidates; spans are in code points, end exclusive; of candidates that tie in probability the one proposed first
stays; repeated rows give repeated results; an empty table gives no rows, and a model from made examples alone; of other
columns of the input those that are added replace theirs, in any case, and the rest stay as they are.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, read, text_udf, with_struct

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "identity")
FIELDS = {"kinds": "array<string>", "starts": "array<int>", "ends": "array<int>"}

#: High-recall generators: (kind, pattern, what the text must hold for it to be tried).
GENERATORS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\bat\b|＠) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?[A-Za-z0-9-]{2,63})+"), ("(at)", "[at]", " dot ", "[dot]", "(dot)", "＠")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])"), None),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+|00|\()?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"), None),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\.) ?[0-9]{1,3}){3}(?![0-9.])"), None),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), None),
    ("identity", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"), None),
]
HINTS = {
    "email": ("mail", "email", "contact", "correo", "adresse", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "telefon", "teléfono", "téléphone"),
    "account": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "identity": ("ssn", "social", "passport", "identity", "dni", "id"),
}
AGAINST = ("price", "total", "version", "order", "page", "figure", "year", "size", "serial", "invoice", "isbn", "chapter", "lot", "ratio")

#: Values of a feature in a cell; an example's weight there; parts of a gradient of 1; steps of a threshold; cells a task holds.
CODES, UNIT, PARTS, STEPS, HELD = 256, 1 << 20, float(1 << 32), 10_000, 1 << 16
GRID = np.arange(STEPS + 1) / STEPS
CELL = "cell binary, fit long, fit_right long, held long, held_right long"

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and dotted domain; found from the @, so in linear time."""
    out: list[Span] = []
    end = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append((start, end, "email"))
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns that hold, leftmost and non-overlapping for each kind, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += emails(text)
    if DIGIT.search(text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    low = text.lower()
    has_digit = DIGIT.search(text) is not None
    out: list[Span] = []
    for kind, pattern, parts in GENERATORS:
        if any(p in low for p in parts) if parts else has_digit:
            out += [(*m.span(), kind) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, as numbers."""
    s, e, kind = span
    x = text[s:e]
    d = digits_of(x)
    groups = [len(g) for g in re.findall(r"[0-9]+", x)] or [0]
    marks = [c for c in x if not c.isalnum()]
    before, after = text[max(0, s - 40) : s].lower(), text[e : e + 20].lower()
    words = re.findall(r"[^\W\d_]+", before)[-4:]
    octets = [int(g) for g in re.findall(r"[0-9]{1,4}", x)]
    mod97 = 0.0
    if kind == "account":
        y = x.replace(" ", "")
        mod97 = float(int("".join(str(int(c, 36)) for c in y[4:] + y[:4])) % 97 == 1)
    return [
        float(KINDS.index(kind)), len(x), len(d), len(groups), max(groups), min(groups), float(groups[0]), float(groups[-1]),
        len(marks), len(set(marks)), float(" " in marks), float("-" in marks), float("." in marks), float("/" in marks), float("(" in marks), float(x[0] in "+("),
        float(luhn(d)) if d else 0.0, float(len(octets) == 4 and max(octets) <= 255), mod97, float(x[:1] == "0" or x[:2] == "00"), len(set(d)), float(int(d[0])) if d else -1.0,
        float(any(w in HINTS[kind] for w in words)), float(any(h in before[-20:] for h in HINTS[kind] if len(h) > 2)), float(any(w in AGAINST for w in words)),
        float(before[-1:] in "$€£#"), float(before[-1:].isalnum()), float(before[-1:] in "=:_/"), float(after[:1].isalnum()), float(after[:1] in "%$€£_/="), float(after[:3].strip()[:2] in ("kg", "km", "mm", "ms", "eu", "us", "pa")),
        float(len(set(groups)) == 1), float("at" in x.lower() and not d),
    ]


def coded(x: np.ndarray) -> np.ndarray:
    """Features as bytes, one up, as the least is -1; larger ones count as the largest."""
    return np.clip(x + 1, 0, CODES - 1).astype(np.uint8)


def descended(tree: tuple, x: np.ndarray, steps: int) -> np.ndarray:
    """Each row's heap position after so many steps; where a node has no split, that node."""
    feature, cut, _ = tree
    place = np.ones(len(x), int)
    for _ in range(steps):
        j = feature[place]
        place = np.where(j >= 0, 2 * place + (x[np.arange(len(x)), j] > cut[place]), place)
    return place


def tree_depth(tree: tuple) -> int:
    return len(tree[0]).bit_length() - 2


class Cells:
    """Features (bytes) with the weight of their examples and of those among them whose label is 1."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, right: np.ndarray):
        self.codes, self.n, self.right = codes, n, right
        self.x = codes.astype(np.int16) - 1
        self.f, self.done = np.zeros(len(n)), 0

    def sums(self, model: dict, level: int) -> np.ndarray:
        """By node of a level of the last tree, feature and code: sums of first and second derivatives, as whole numbers."""
        *before, last = model["trees"] or [None]
        for tree in before[self.done :]:
            self.f += tree[2][descended(tree, self.x, tree_depth(tree))]
        self.done = len(before)
        p = 1 / (1 + np.exp(-self.f - model["start"]))
        place = descended(last, self.x, level) if last else np.ones(len(p), int)
        rows = np.flatnonzero(place >= 2**level)
        node, codes, p, n = (place[rows] - 2**level) * CODES, self.codes[rows], p[rows], self.n[rows]
        parts = [np.round(v * PARTS) for v in (self.right[rows] - p * n, (p * (1 - p) + 1e-6) * n)]
        by = [[np.bincount(node + c, v, 2**level * CODES).reshape(-1, CODES) for v in parts] for c in codes.T]
        return np.array(by).transpose(2, 0, 3, 1)

    def scores(self, model: dict) -> np.ndarray:
        """By kind and step of the score: weight, and that of label 1, as whole numbers."""
        at = self.x[:, 0].astype(int) * (STEPS + 1) + np.searchsorted(GRID, probability(model, self.x), "right") - 1
        return np.stack([np.bincount(at, np.round(v * PARTS), len(KINDS) * (STEPS + 1)).reshape(-1, STEPS + 1) for v in (self.n, self.right)], 2)


def grown(sums: Callable[[dict, int], np.ndarray], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 3.0) -> dict:
    """Gradient boosting on log loss with histogram splits; a tree is arrays of feature, cut and leaf by heap position."""
    model = {"start": 0.0, "trees": []}
    whole = sums(model, 0)[0]  # at a probability of 1/2, the sums tell the counts
    n = whole[:, :, 1] / (0.25 + 1e-6)
    share = np.clip(0.5 + whole[0, :, 0].sum() / n[0].sum(), 0.01, 0.99)
    cuts = [np.unique(np.searchsorted(np.cumsum(c), np.linspace(0, 1 - 1e-9, bins) * c.sum(), "left")) for c in n]
    model["start"] = float(np.log(share / (1 - share)))
    for _ in range(trees):
        size = 2 ** (depth + 1)
        feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
        model["trees"].append((feature, cut, leaf))
        reached = {1}
        for level in range(depth):
            if not any(k >= 2**level for k in reached):
                break
            found = sums(model, level) / PARTS
            for k in sorted(k for k in reached if k >= 2**level):
                left_g, left_h = np.moveaxis(np.cumsum(found[k - 2**level], 1), 2, 0)
                total_g, total_h = left_g[0, -1], left_h[0, -1]
                leaf[k] = rate * total_g / (total_h + 1)
                if total_h < 2 * least:
                    continue
                best = 1e-3
                for j, c in enumerate(cuts):
                    gl, hl = left_g[j, c], left_h[j, c]
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    gain[(hl < least) | (total_h - hl < least)] = 0
                    at = int(gain.argmax())
                    if gain[at] > best:
                        best, feature[k], cut[k] = gain[at], j, c[at] - 1
                        leaf[2 * k], leaf[2 * k + 1] = rate * gl[at] / (hl[at] + 1), rate * (total_g - gl[at]) / (total_h - hl[at] + 1)
                if feature[k] >= 0:
                    reached |= {2 * k, 2 * k + 1}
    return model


def boost(x: np.ndarray, y: np.ndarray, **options) -> dict:
    """Trees from rows of features and their labels."""
    return grown(Cells(coded(x), np.ones(len(y)), y).sums, **options)


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["start"])
    for tree in model["trees"]:
        f += tree[2][descended(tree, x, tree_depth(tree))]
    return 1 / (1 + np.exp(-f))


def made_examples(n: int, seed: int = 3) -> list[tuple[list[float], int]]:
    """Personal data in other dress, and numbers that are none, in lines made by rule."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice([".", "/", " ", "-", "_", "  "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        country, body = r.choice(["DE", "FR", "ES", "GB"]), num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        y = f"{country}{check:02d}{body}"
        return r.choice([y, " ".join(y[i : i + 4] for i in range(0, len(y), 4))])

    yes = [
        ("card", card),
        ("phone", lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00{} {} {}", "0{} {}{}"]).format(num(3), num(3), num(4))),
        ("email", lambda: f"{word()} {r.choice(['(at)', '[at]', 'at'])} {word()} {r.choice(['(dot)', '[dot]', 'dot'])} {r.choice(['com', 'org', 'net'])}"),
        ("ip", lambda: r.choice(["[.]", "(.)"]).join(str(r.randint(1, 255)) for _ in range(4))),
        ("account", iban),
        ("identity", lambda: f"{num(3)}-{num(2)}-{num(4)}"),
    ]
    no = [
        lambda: f"{r.randint(1, 999)}.{num(3)}.{num(3)}", lambda: f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}.{num(2)}", lambda: num(r.randint(7, 16)),
        lambda: f"{r.randint(1, 40)}.{r.randint(0, 99)}.{r.randint(256, 999)}.{r.randint(0, 999)}", lambda: f"{num(3)}-{num(5)}-{num(4)}-{num(1)}", lambda: f"{num(4)}/{num(4)}",
        lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{word()} at {word()} dot", lambda: f"{num(3)} {num(3)} {num(3)}",
    ]
    out = []
    for i in range(n):
        positive = i % 2 == 0
        kind, make = r.choice(yes) if positive else (None, r.choice(no))
        value = make()
        weak = kind in ("phone", "identity")  # their form alone says little: the company must tell
        lead = r.choice(HINTS[kind]) + r.choice([" ", ": "]) if kind and (weak or r.random() < 0.6) else (r.choice(AGAINST) + " " if r.random() < 0.5 else word() + " ")
        line = " ".join(word() for _ in range(r.randint(1, 5))) + " " + lead + value + r.choice(["", ".", ",", " " + word()])
        at = line.index(value)
        for c in candidates(line):
            hit = positive and c[2] == kind and c[0] <= at + 1 and c[1] >= at + len(value) - 1
            if hit or not positive or c[1] <= at or c[0] >= at + len(value):
                out.append((features(line, c), int(hit)))
    return out


def examples(text: str | None, most: int) -> Iterator[tuple[bytes, int, bool, bool]]:
    """All candidates of a text: cell, weight (that of ``most`` together, where there are more), whether a base span of their kind
    covers them, whether they are held out from the trees (by hash)."""
    found = candidates(text) if text else []
    covers = {k: disjoint([(s, e) for s, e, kind in base_spans(text) if kind == k]) for k in BASE} if found else {}
    weight = max(1, round(UNIT * min(1, most / max(1, len(found)))))
    for s, e, kind in found:
        cell = bytes([min(max(int(v) + 1, 0), CODES - 1) for v in features(text, (s, e, kind))])
        yield cell, weight, kind in covers and within(covers[kind], s, e), zlib.crc32(f"{s}:{e}:{kind}:{len(text)}".encode()) % 10 >= 7


def corpus_cells(docs: DataFrame, per_document: int) -> DataFrame:
    """Cells of all candidates of all rows: weights to fit and held out, and of label 1 in each. A null cell's ``fit`` counts rows."""
    names = ["cell", "fit", "fit_right", "held", "held_right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes | None, list[int]] = {}

        def rows() -> pa.RecordBatch:
            columns = [list(held), *([v[i] for v in held.values()] for i in range(4))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), *[pa.int64()] * 4], strict=True)], names)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.setdefault(None, [0] * 4)[0] += 1
                for cell, weight, right, out in examples(text, per_document):
                    counts = held.setdefault(cell, [0] * 4)
                    counts[2 * out] += weight
                    counts[2 * out + 1] += weight * right
                    if len(held) > HELD:
                        yield rows()
                        held.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, CELL).groupBy("cell").agg(*[F.sum(c).alias(c) for c in names[1:]])


def cells_of(table: pa.Table | pa.RecordBatch, part: str, weight: float) -> Cells:
    """The rows that have examples of a part (fit, held)."""
    n, right = (table.column(c).to_numpy() * weight for c in (part, f"{part}_right"))
    codes = np.frombuffer(b"".join(table.column("cell").to_pylist()), np.uint8).reshape(len(n), -1) if len(n) else np.zeros((0, 1), np.uint8)
    return Cells(codes[n > 0], n[n > 0], right[n > 0])


def summed(cells: DataFrame, shape: tuple, make: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``make(batch)``, arrays of a shape whose last axis is two, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        flat = total.reshape(-1, 2)
        at = np.flatnonzero(flat.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at, 0]), pa.array(flat[at, 1])], ["at", "u", "v"])

    found = cells.mapInArrow(run, "at long, u double, v double").groupBy("at").agg(F.sum("u").alias("u"), F.sum("v").alias("v")).toArrow()  # of a fixed size
    out = np.zeros((int(np.prod(shape)) // 2, 2))
    out[found.column("at").to_numpy()] = np.stack([found.column(c).to_numpy() for c in "uv"], 1)
    return out.reshape(shape)


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order; spans that touch stay apart."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def within(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the disjoint, sorted spans covers start to end."""
    i = bisect_left(spans, (start + 1,)) - 1
    return i >= 0 and end <= spans[i][1]


def free(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether start to end overlaps none of the disjoint, sorted spans."""
    i = bisect_left(spans, (end,)) - 1
    return i < 0 or spans[i][1] <= start


def pii_model(docs: DataFrame, documents: int = 6000, made: int = 6000, precision: float = 0.99, per_document: int = 20, gathered: int = 1 << 17) -> dict:
    """Trees and a threshold for each kind."""
    data = made_examples(made)
    codes, y = coded(np.array([f for f, _ in data])), np.array([v for _, v in data], float)
    part = np.random.default_rng(1).random(len(y)) < 0.7
    own = {name: Cells(codes[at], np.ones(at.sum()), y[at]) for name, at in (("fit", part), ("held", ~part))}

    cells = materialise(corpus_cells(docs, per_document), "cells")
    told = cells.agg(F.count("cell").alias("cells"), F.sum(F.when(F.col("cell").isNull(), F.col("fit"))).alias("rows")).first()
    cells = cells.where("cell is not null")
    weight = min(1, documents / max(1, told["rows"] or 0)) / UNIT
    if told["cells"] <= gathered:
        table = cells.orderBy("cell").toArrow()
        corpus = {name: cells_of(table, name, weight) for name in own}
        more = lambda name, shape, what: what(corpus[name]) if len(corpus[name].n) else 0
    else:
        more = lambda name, shape, what: summed(cells, shape, lambda batch: what(cells_of(batch, name, weight)))

    def both(name: str, what: Callable[[Cells], np.ndarray]) -> np.ndarray:
        mine = what(own[name])
        return mine + more(name, mine.shape, what)

    model = grown(lambda model, level: both("fit", lambda c: c.sums(model, level)))
    model["threshold"] = {}
    for name, steps in zip(KINDS, both("held", lambda c: c.scores(model)), strict=True):
        n, right = np.cumsum(steps[::-1], 0).T / PARTS  # from the highest score down
        good = np.flatnonzero((steps[::-1, 0] > 0) & (n > 10) & (right >= precision * n))
        model["threshold"][name] = max(0.5, float(GRID[::-1][good[-1]])) if len(good) else 2.0  # too little evidence: none
    return model


def scan(text: str | None, model: dict) -> list[Span]:
    """All spans of a text by kind, then start."""
    if not text:
        return []
    out = base_spans(text)
    taken = disjoint([(s, e) for s, e, _ in out])
    proposed = [c for c in candidates(text) if free(taken, c[0], c[1])]
    if proposed:
        p = np.concatenate([probability(model, np.array([features(text, c) for c in proposed[i : i + 4096]], float)) for i in range(0, len(proposed), 4096)])
        for i in np.argsort(-p, kind="stable"):
            s, e, kind = proposed[i]
            if p[i] >= model["threshold"][kind] and free(taken, s, e):
                out.append((s, e, kind))
                insort(taken, (s, e))
    return sorted(out, key=lambda s: (KINDS.index(s[2]), s[0], s[1]))


def find_pii(docs: DataFrame, model: dict) -> DataFrame:
    """Add pii_kinds, pii_starts, pii_ends (arrays), base_kinds, base_starts, base_ends to every row of ``docs``."""

    def run(texts: list[str | None]) -> list[list]:
        found = [scan(t, model) for t in texts]
        base = [base_spans(t) if t else [] for t in texts]
        return [[[s[i] for s in f] for f in spans] for spans in (found, base) for i in (2, 0, 1)]

    fields = {f"{p}_{f}": t for p in ("pii", "base") for f, t in FIELDS.items()}
    return with_struct(docs, "_pii", text_udf(fields, lambda: run)("text"), list(fields))


def redacted(text: F.Column, starts: F.Column, ends: F.Column, kinds: F.Column) -> F.Column:
    """The text with each span replaced by its kind in brackets (spans may come in any order and touch)."""
    spans = F.reverse(F.array_sort(F.arrays_zip(starts.alias("s"), ends.alias("e"), kinds.alias("k"))))
    cut = lambda t, x: F.concat(F.substring(t, F.lit(1), x["s"]), F.lit("["), x["k"], F.lit("]"), F.substring(t, x["e"] + 1, F.length(t)))
    return F.aggregate(spans, text, cut)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import count_of, joined

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, pii_model(docs))
    return found.select(
        "doc_id", *[count_of("base_kinds", k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined("base_kinds", "base_starts", "base_ends"), 256).alias("base_sha256"), joined("pii_kinds", "pii_starts", "pii_ends").alias("spans"),
    )
