"""Secret scan: fixed patterns, and a linear-chain conditional random field for what they miss.

The fixed patterns (assign, access, hex) give the base spans, always kept. The field tags every token, ordinary words
too, of the lines that hold a value-like token or a key word: secret begin, inside or outside, from its shape, the words
beside it and features of the file. A line is a chain, and Viterbi decodes its tags. Value-like means a digit and a letter
with nothing but marks between them, a capital after a small letter, or 20 characters and more; lines with neither such
a token nor a key word have no learned spans. Names part from their values at '='.

Training: lines of at most ``documents`` documents (the smallest hashes of the id), of each its lines of the smallest hashes of
their places up to MOST_TOKENS tokens, from all of the text, labelled by the base patterns, and synthetic lines made by rule that show secrets, of one token and of several, and
look-alikes (commit ids, checksums, UUIDs, paths, version strings, prose with key words) in their usual company. The seed
is fixed.

Defined results: null and empty texts have no spans; whole texts are scanned, line by line, in time linear in their length;
spans are in code points, end exclusive; a learned span that overlaps a base span is left out; where two taggings weigh the same
the one with tags outside first wins; a token without a letter or digit begins no secret; repeated rows give repeated results; an empty table gives no rows, and a field
from made lines alone; of other columns of the input those that are added replace theirs, in any case, the rest stay.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import document_sample, in_order, read, text_udf, with_struct

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
TOKEN = re.compile(r"[\w+/.~-]+(?:={1,2}(?![\w+/.~=-]))?")
TELLING = re.compile(
    r"[0-9][+/_.~=-]*[A-Za-z]|[A-Za-z][+/_.~=-]*[0-9]|[a-z][A-Z]|[\w+/.~-]{20}|(?i:pass|pwd|secret|token|key|auth|bearer|credential|login|\bpin\b)"
)
WINDOW, MOST_TOKENS = 16, 48
NEAR = re.compile(r"[A-Za-z]+|[:=\"'{}$<>@]")
SLOTS, TAGS = 1 << 14, 3
OUT, BEGIN, INSIDE = range(TAGS)
FIELDS = {"kinds": "array<string>", "starts": "array<int>", "ends": "array<int>"}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping for each kind; failing matches are dropped."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):  # a cheap necessary condition
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if LONG_HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def shape(token: str) -> list[str]:
    """What a token looks like: length, alphabet, mixture, known beginnings."""
    n = len(token)
    counts = Counter(token)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digits = sum(c.isdigit() for c in token) / n
    kinds = "".join(k for k, f in (("a", str.islower), ("A", str.isupper), ("0", str.isdigit)) if any(map(f, token)))
    marks = "".join(sorted({c for c in token if not c.isalnum()}))
    alphabet = "hex" if re.fullmatch(r"[0-9a-f]+", token) else "b64" if re.fullmatch(r"[A-Za-z0-9+/]+=*", token) else "other"
    runs = len(re.findall(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", token)) / n
    head = re.match(r"[A-Za-z]{2,5}(?=[_-])|[A-Z]{3,4}|eyJ|[A-Za-z]*", token)[0][:5]
    return [
        f"len{min(n // 8, 8)}", f"al{alphabet}", f"kinds{kinds}", f"marks{marks}", f"head{head}", f"entropy{int(entropy * 2)}",
        f"digits{int(digits * 6)}", f"runs{int(runs * 8)}", f"{alphabet}{min(n // 8, 8)}", f"words{bool(re.search('[a-z]{6}', token))}",
        f"dots{min(token.count('.'), 3)}", f"slashes{min(token.count('/'), 3)}", f"dashes{min(token.count('-'), 5)}",
        f"own{token.lower() if token.isalpha() else ''}",
    ]


@lru_cache(1 << 16)
def slot(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little") % SLOTS


#: What a token's features come from: itself ("own"), or a word or mark beside it, by side and distance.
Key = tuple[str, int, str]


def slots_of(key: Key) -> list[int]:
    """Slots of the features that one key stands for."""
    side, i, word = key
    if side == "own":
        return [slot(w) for w in shape(word)]
    return [slot(f"before{i}{word}"), slot(f"any{word}")] if side == "before" else [slot(f"after{i}{word}")]


def keys_of(text: str, start: int, end: int, tokens: list[tuple[int, int]]) -> list[list[Key]]:
    """Keys of tokens of the line from start to end: the token, four words or marks before it and two after it."""
    near = [(m.start(), m.end(), m[0].lower()) for m in NEAR.finditer(text, start, end)]
    firsts, lasts = [x[0] for x in near], [x[1] for x in near]
    out = []
    for s, e in tokens:
        i, j = bisect_right(lasts, s), bisect_left(firsts, e)
        before = [("before", n, x[2]) for n, x in enumerate(reversed(near[max(0, i - 4) : i]))]
        out.append([("own", 0, text[s:e]), *before, *[("after", n, x[2]) for n, x in enumerate(near[j : j + 2])]])
    return out


def features(text: str, start: int, end: int, tokens: list[tuple[int, int]], file: list[str]) -> list[list[int]]:
    """Hashed features of tokens of the line from start to end: shape, neighbours on the line, file."""
    whole = [slot(w) for w in file]
    return [[x for key in keys for x in slots_of(key)] + whole for keys in keys_of(text, start, end, tokens)]


def file_features(text: str) -> list[str]:
    n = len(text) + 1
    return [f"code{min(5, int(200 * sum(text.count(c) for c in '=;{}()') / n))}", f"long{min(4, len(text) // 1000)}", f"quotes{min(3, int(100 * text.count(chr(34)) / n))}"]


#: The parts of TELLING one by one, each beginning with what is rare in prose.
PARTS = [re.compile(p) for p in (
    r"[0-9][+/_.~=-]*[A-Za-z]", r"[0-9](?<=[A-Za-z].)", r"[+/_.~=-](?<=[A-Za-z].)[+/_.~=-]*[0-9]", r"[A-Z](?<=[a-z].)", r"[^\w+/.~-][\w+/.~-]{20}",
)]
AT_START = re.compile(r"[\w+/.~-]{20}")
WORDS, PIN = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login"), re.compile(r"(?i:\bpin\b)")
ANY_WORD = re.compile(f"(?i:{'|'.join(WORDS)}|\\bpin\\b)")
#: Letters that count as others where case doesn't, but have other small forms.
ODD_LETTERS = "\u017f\u0130\u0131\u212a"


def lines(text: str) -> list[tuple[int, int]]:
    """Start and end of the lines that hold a value-like token or a key word, in order: those where TELLING matches."""
    found: set[tuple[int, int]] = set()

    def line_at(at: int) -> int:
        end = text.find("\n", at)
        end = end if end >= 0 else len(text)
        found.add((text.rfind("\n", 0, at) + 1, end))
        return end

    if AT_START.match(text):
        line_at(0)
    low = text.lower()
    patterns = PARTS
    if len(low) != len(text) or any(c in text for c in ODD_LETTERS):
        patterns = [*PARTS, ANY_WORD]
    else:
        for w in WORDS:
            at = low.find(w)
            while at >= 0:
                at = low.find(w, line_at(at))
        if "pin" in low:
            patterns = [*PARTS, PIN]
    for pattern in patterns:
        at = 0
        while m := pattern.search(text, at):
            at = line_at(m.end() - 1)
    return sorted(found)


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, start, end)]


def labels(tokens: list[tuple[int, int]], parts: list[tuple[int, int]]) -> list[int]:
    """Tags of tokens, given where secrets lie (sorted): the first token that overlaps a secret begins it."""
    tags, last, at = [], -1, 0
    for s, e in tokens:
        while at < len(parts) and parts[at][1] <= s:
            at += 1
        if at < len(parts) and parts[at][0] < e:
            tags.append(INSIDE if at == last else BEGIN)
            last = at
        else:
            tags.append(OUT)
    return tags


#: Tags that may follow each other: inside only after begin or inside.
ALLOWED = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])


def forward_backward(node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains of equal length (chain, place, tag): log partitions, tag probabilities, expected transitions of all together.

    A chain starts after 'outside'.
    """
    n, step = node.shape[1], edge + ALLOWED
    a, b = np.zeros(node.shape), np.zeros(node.shape)
    a[:, 0] = node[:, 0] + step[OUT]
    for i in range(1, n):
        a[:, i] = node[:, i] + np.logaddexp.reduce(a[:, i - 1, :, None] + step, axis=1)
    for i in range(n - 2, -1, -1):
        b[:, i] = np.logaddexp.reduce(step + (node[:, i + 1] + b[:, i + 1])[:, None], axis=2)
    z = np.logaddexp.reduce(a[:, -1], axis=1)
    p = np.exp(a + b - z[:, None, None])
    pairs = np.exp(a[:, :-1, :, None] + step + (node + b)[:, 1:, None] - z[:, None, None, None]).sum(axis=(0, 1))
    pairs[OUT] += p[:, 0].sum(axis=0)
    return z, p, pairs


def viterbi(node: np.ndarray, edge: np.ndarray) -> list[int]:
    step = edge + ALLOWED
    best, back = node[0] + step[OUT], []
    for x in node[1:]:
        way = best[:, None] + step
        back.append(way.argmax(0))
        best = way.max(0) + x
    tags = [int(best.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def train(chains: list[tuple[list[list[int]], list[int]]], rounds: int = 12, rate: float = 0.2, decay: float = 1e-4, together: int = 16) -> dict[str, np.ndarray]:
    """AdaGrad on the chains' conditional log-likelihood, by batches of ``together`` chains of equal length."""
    w, edge = np.zeros((SLOTS, TAGS)), np.zeros((TAGS, TAGS))
    gw, ge = np.full_like(w, 1e-2), np.full_like(edge, 1e-2)
    order = np.random.default_rng(5)
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for tokens, tags in chains:
        by_length.setdefault(len(tags), []).append((np.array([len(f) for f in tokens]), np.concatenate(tokens), np.array(tags)))
    for _ in range(rounds):
        batches = [(n, part) for n, own in sorted(by_length.items()) for part in np.array_split(order.permutation(len(own)), -(-len(own) // together))]
        for k in order.permutation(len(batches)):
            n, part = batches[k]
            some = [by_length[n][i] for i in part]
            sizes, slots = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
            tags = np.stack([x[2] for x in some])
            node = np.add.reduceat(w[slots], np.cumsum(sizes) - sizes, axis=0)
            _, p, pairs = forward_backward(node.reshape(len(some), n, TAGS), edge)
            grad = -pairs
            np.add.at(grad, (np.c_[np.full(len(some), OUT), tags[:, :-1]], tags), 1)
            g = np.eye(TAGS)[tags.ravel()] - p.reshape(-1, TAGS) - decay * node / sizes[:, None]
            here, place = np.unique(slots, return_inverse=True)
            spread = np.repeat(g, sizes, axis=0)
            sums = np.stack([np.bincount(place, spread[:, t], len(here)) for t in range(TAGS)], axis=1)
            gw[here] += np.stack([np.bincount(place, spread[:, t] ** 2, len(here)) for t in range(TAGS)], axis=1)
            w[here] += rate * sums / np.sqrt(gw[here])
            ge += grad * grad
            edge += rate * grad / np.sqrt(ge)
    return {"w": w.astype(np.float32), "edge": edge}


def synthetic(n: int, seed: int = 11) -> list[tuple[list[list[int]], list[int]]]:
    """Chains from made lines: secrets and look-alikes of common forms, each in fitting and in neutral company."""
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda alphabet, lo, hi: "".join(r.choice(alphabet) for _ in range(r.randint(lo, hi)))
    word = lambda: some(lower, 2, 9)
    secret = [
        lambda: r.choice(["ghp_", "gho_", "glpat-", "npm_", "hf_"]) + some(lower + upper + digits, 20, 40),
        lambda: r.choice(["sk_live_", "sk-", "pk_live_", "rk_live_", "sk-proj-"]) + some(lower + upper + digits, 24, 48),
        lambda: "xoxb-" + some(digits, 10, 12) + "-" + some(lower + upper + digits, 20, 24),
        lambda: "AIza" + some(lower + upper + digits + "_-", 35, 35),
        lambda: "eyJ" + some(lower + upper + digits, 20, 40) + "." + some(lower + upper + digits, 20, 60) + "." + some(lower + upper + digits + "_-", 30, 43),
        lambda: some(lower + upper + digits + "+/", 32, 64),
        lambda: some(lower + upper + digits, 20, 40),
        lambda: "SG." + some(lower + upper + digits, 22, 22) + "." + some(lower + upper + digits, 43, 43),
    ]
    weak = [  # told by their company alone
        lambda: r.choice(["-", "_", "."]).join(word() for _ in range(r.randint(3, 5))),
        lambda: word().capitalize() + some(digits, 1, 3) + word(),
        lambda: some(lower + upper, 8, 14),
        lambda: word() + some(digits, 2, 4),
        lambda: some(lower + upper + digits, 10, 24) + r.choice(["", "=", "=="]),
        lambda: some(lower + upper + digits, 3, 6) + r.choice("!@#$%&*") + some(lower + upper + digits, 2, 6) + r.choice(["", "!", "#" + word()]),
        lambda: " ".join(word() for _ in range(r.randint(3, 5))),
    ]
    plain = [
        lambda: "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        lambda: "/".join(word() for _ in range(3)) + f"/v{r.randint(1, 9)}.{r.randint(0, 20)}",
        lambda: word() + "-" + word() + f"-{r.randint(1, 20)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
        lambda: word() + "_" + word() + "_" + str(r.randint(1, 9999)),
        lambda: f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}Z",
        lambda: "www." + word() + str(r.randint(1, 99)) + ".example.com",
        lambda: word() + word() + word() + str(r.randint(0, 9)),
        lambda: "sha256-" + some("0123456789abcdef", 8, 12),
    ]
    keys = ["Authorization: Bearer ", "client_secret = ", '"access_token": "', "export API_KEY=", "private_key: ", "credentials ", "auth ", "key = ", "bearer ", "pwd=", ""]
    strong = ["pwd: ", "passphrase: ", "Authorization: Basic ", "passcode = ", "pwd=", "login password is: ", "auth: "]
    names = ["PWD", "PASS", "KEY", "API_KEY", "AUTH", "CREDENTIAL", "LOGIN_KEY", "PASSPHRASE", "PRIVATE_KEY"]
    prose = ["password", "key", "pass", "token", "secret", "author", "authority", "login", "keys", "passage", "monkey", "iPhone", "2nd", "3rd", "10am", "A4"]
    env = lambda: r.choice(["", "export "]) + r.choice(["", some(upper, 2, 8) + "_"]) + r.choice(names) + "="
    others = ["commit ", "checksum ", "see ", "version ", "file ", "id ", "uuid: ", "build ", "path=", "url: ", "release ", "from ", ""]
    out = []
    for i in range(n):
        is_secret = i % 2 == 0
        before = " ".join(word() for _ in range(r.randint(0, 5)))
        if i % 6 == 0:
            value, lead = r.choice(weak)(), r.choice([env, lambda: r.choice(strong)])()
        elif i % 6 == 1:
            said = [word() for _ in range(r.randint(3, 12))]
            said.insert(r.randint(0, len(said)), r.choice(prose))
            value, lead = " ".join(said) + r.choice(["", "."]), ""
        else:
            value = r.choice(secret if is_secret else plain)()
            lead = r.choice(keys) if is_secret == (r.random() < 0.9) else r.choice(others)
            lead = env() if is_secret and r.random() < 0.2 else lead
        if " " in value and is_secret:
            lead, end = lead + '"', '"'
        elif lead.endswith('"'):
            end = '"'
        else:
            end = r.choice(["", '"', ";", " " + word(), ","])
        if lead.endswith('="') or lead.startswith("export") or r.random() < 0.2:
            before = ""
        line = before + (" " if before else "") + lead + value + end
        at = len(line) - len(end) - len(value)
        for start, stop in lines(line):
            tokens = tokens_of(line, start, stop)
            out.append((features(line, start, stop, tokens, file_features(line)), labels(tokens, [(at, at + len(value))] if is_secret else [])))
    return out


def secret_parts(text: str) -> list[tuple[int, int]]:
    """Where the base spans' secrets lie, overlapping ones as one: of an assignment the value alone."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((ASSIGN.match(text, s).start(2) if k == "assign" else s, e) for s, e, k in base_spans(text)):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def examples(text: str | None, window: int = WINDOW, most: int = MOST_TOKENS) -> list[tuple[list[list[int]], list[int]]]:
    """Chains of a text labelled by its base spans: of each line ``window`` tokens around the first secret or telling token."""
    if not text:
        return []
    parts, file, out, left = secret_parts(text), file_features(text), [], most
    for start, end in sorted(lines(text), key=lambda x: (crc32(f"{x[0]}:{x[1]}:{len(text)}".encode()), x)):
        tokens = tokens_of(text, start, end)
        tags = labels(tokens, parts)
        telling = [i for i, (s, e) in enumerate(tokens) if tags[i]] or [i for i, (s, e) in enumerate(tokens) if TELLING.search(text, s, e)] or [0]
        first = max(0, telling[0] - window // 2)
        while first and tags[first] == INSIDE:
            first -= 1
        tokens, tags = tokens[first : first + window][:left], tags[first : first + window][:left]
        if not tokens:
            continue
        out.append((features(text, start, end, tokens, file), tags))
        left -= len(tokens)
        if not left:
            break
    return out


def secret_model(docs: DataFrame, documents: int = 4000, made: int = 3000, window: int = WINDOW, most: int = MOST_TOKENS) -> dict[str, np.ndarray]:
    """Fit the field on the chains of ``documents`` documents, ``most`` tokens of each in windows of ``window``, and ``made`` synthetic lines."""

    def collect(texts: list[str | None]) -> list[list]:
        got = [examples(t, window, most) for t in texts]
        return [[[len(c) for _, tags in g for c in [tags]] for g in got], [[t for _, tags in g for t in tags] for g in got], [[len(f) for tokens, _ in g for f in tokens] for g in got], [[x for tokens, _ in g for f in tokens for x in f] for g in got]]

    fields = {"chains": "array<int>", "tags": "array<int>", "sizes": "array<int>", "slots": "array<int>"}
    found = document_sample(docs, documents).select("doc_id", text_udf(fields, lambda: collect)("text").alias("x"))
    rows = in_order(found.select("doc_id", "x.*").where(F.size("chains") > 0).collect())
    chains = synthetic(made)
    for r in rows:
        slots, sizes, tags = iter(r["slots"]), iter(r["sizes"]), iter(r["tags"])
        for n in r["chains"]:
            tokens = [[next(slots) for _ in range(next(sizes))] for _ in range(n)]
            chains.append((tokens, [next(tags) for _ in range(n)]))
    return train(chains)


class Field:
    """The trained field over texts. A token's score is the sum of its keys' scores, which are kept: most words come again."""

    def __init__(self, model: dict[str, np.ndarray], most: int = 300_000):
        self.w, self.edge, self.most = model["w"].astype(float), model["edge"], most
        self.rows: dict[Key, int] = {}
        self.table = np.zeros((1024, TAGS))
        stay = self.edge[OUT, OUT]
        leave = max(0.0, float((self.edge[:, OUT] - stay).max()))
        #: More than a token can add to a path, beside its own score, where it isn't outside.
        self.slack = np.array([float((self.edge[:, t] - stay)[ALLOWED[:, t] == 0].max()) + leave for t in (BEGIN, INSIDE)])

    def row(self, key: Key) -> int:
        r = self.rows.get(key)
        if r is None:
            r = self.rows[key] = len(self.rows)
            if r == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[r] = self.w[slots_of(key)].sum(0)
        return r

    def spans(self, text: str) -> list[Span]:
        """Spans that the field tags. A line is decoded only where some token could outweigh its being outside.

        A token without a letter or a digit never begins a secret.
        """
        if len(self.rows) > self.most:
            self.rows = {}
        parts, ids, sizes = [], [], []
        for start, end in lines(text):
            tokens = tokens_of(text, start, end)
            if tokens:
                parts.append(tokens)
                for keys in keys_of(text, start, end, tokens):
                    sizes.append(len(keys))
                    ids += [self.row(k) for k in keys]
        if not parts:
            return []
        size = np.array(sizes)
        node = np.add.reduceat(self.table[ids], np.cumsum(size) - size, axis=0) + self.w[[slot(w) for w in file_features(text)]].sum(0)
        bare = [i for i, (s, e) in enumerate(t for tokens in parts for t in tokens) if not any(map(str.isalnum, text[s:e]))]
        node[bare, BEGIN] = -1e9
        could = (node[:, [BEGIN, INSIDE]] - node[:, [OUT]] + self.slack).max(axis=1) > 0
        out: list[Span] = []
        at = 0
        for tokens in parts:
            here = slice(at, at + len(tokens))
            at += len(tokens)
            if could[here].any():
                for (s, e), tag in zip(tokens, viterbi(node[here], self.edge), strict=True):
                    if tag == INSIDE and out:
                        out[-1] = (out[-1][0], e, "crf")
                    elif tag == BEGIN:
                        out.append((s, e, "crf"))
        return out


def learned_spans(text: str, field: Field, base: list[Span]) -> list[Span]:
    """Spans that the field tags, without those that overlap base spans."""
    out = field.spans(text)
    starts, furthest = [s for s, _, _ in base], [0, *accumulate((e for _, e, _ in base), max)]
    return [x for x in out if furthest[bisect_left(starts, x[1])] <= x[0]]


def scan(text: str | None, field: Field) -> list[Span]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + learned_spans(text, field, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spans_of(model: dict[str, np.ndarray]):
    """An Arrow UDF: kinds, starts and ends of all spans of a text."""

    def make():
        field = Field(model)

        def run(texts: list[str | None]) -> list[list]:
            found = [scan(t, field) for t in texts]
            return [[[s[i] for s in f] for f in found] for i in (2, 0, 1)]

        return run

    return text_udf(FIELDS, make)


def find_secrets(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Add secret_kinds, secret_starts, secret_ends (arrays) to every row of ``docs``."""
    names = F.struct(*[F.col(f"_s.{f}").alias(f"secret_{f}") for f in FIELDS])
    found = docs.withColumn("_s", spans_of(model)("text"))
    return with_struct(found, "_secrets", names, [f"secret_{f}" for f in FIELDS]).drop("_s")


def joined(kinds: str, starts: str, ends: str, only: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans in order, comma-joined."""
    spans = F.arrays_zip(F.col(kinds).alias("k"), F.col(starts).alias("s"), F.col(ends).alias("e"))
    if only:
        spans = F.filter(spans, lambda x: x["k"].isin(*only))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))))


def count_of(kinds: str, kind: str) -> Column:
    return F.size(F.filter(F.col(kinds), lambda k: k == kind)).cast("long")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, secret_model(docs))
    arrays = ("secret_kinds", "secret_starts", "secret_ends")
    return found.select(
        "doc_id", *[count_of("secret_kinds", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(*arrays, only=KINDS[:3]), 256).alias("base_sha256"), joined(*arrays).alias("spans"),
    )
