"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns words into classes: insult, violent verb, intention, target, negation, reporting verb, contrast, other.
Five weighted transducers read them, each with states and arcs of its own: insults (a chain of insults weighs more), threats
(a violent verb after an intention is a threat), negation (mutes what follows within a few words), reported speech (turns
what follows into a quotation) and targets (an insult or threat near a word for a person, before it or after it). A contrast
word ends negation and reported speech, a clause's end ends all. They are composed into one machine, the weights of
whose arcs are products of the parts'. It reads each clause with an insult or violent verb in it and writes events: plain,
targeted, negated, reported and so on, each with the weight of its arc and of its word's stem.

A matched clause counts once for each kind of event, by its heaviest one; its weight is their sum. A document's load is the
weight of its matched clauses over the square root of the number of all its clauses, and its score a logistic function of
the load with one learned scale, never below zero, and one learned level. So the arcs' weights are the score: of two texts
that differ in scope alone, the one that the grammar weighs more scores more. Words as such count for nothing.
``find_toxic_clauses`` gives the clauses themselves.

The insult lexicon is an acceptor of word beginnings: a fixed seed and the stems whose share among toxic documents is
``ratio`` times that among others, counted on at most ``per_class`` labelled documents of each value (the smallest
hashes of the id). Seed words that aren't among the stems, and violent verbs, weigh like the middle one of the stems. Scale and
level are fitted on the same documents.

Defined results: null, empty and wordless texts match nothing and get the score of such texts; whole texts are read, clause
by clause, in memory that grows with the one text; repeated rows and ties get equal scores; an empty table gives no rows;
without labelled documents of both values the score is the share of label 1 (0 without any label); other columns of the
input, whatever their names, stay as they are in find_toxic_clauses, but for those that it adds, which replace theirs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_cnn import logistic
from tidemark.llm.common import crc_mod, in_order, labelled_sample, read, text_udf, with_struct

# Seed words of the grammar in the corpus's four languages.
INSULTS = "idiot moron stupid pathetic worthless loser scum trash disgusting imbecile idiota estúpido imbécil basura idiote stupide débile ordure dumm trottel abschaum".split()
VIOLENT = "kill hurt destroy beat stab shoot matar golpear destruir tuer frapper détruire töten schlagen vernichten".split()
INTENTIONS = "will gonna shall should must want werde werden sollte muss voy vamos quiero debe vais veux devrait faut".split()
TARGETS = "you your yours he she they him her them tu te vous ton votre toi usted ustedes ti du dich dir ihr euch sie".split()
NEGATIONS = "not no never isn aren wasn don doesn didn ne pas jamais nicht kein keine nie nunca jamás".split()
REPORTED = "said says say wrote claimed called reported quoted dijo dice según dit écrit selon sagte schrieb laut".split()
CONTRASTS = "but however yet though although aber doch jedoch sondern pero sino aunque mais cependant pourtant".split()
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
LENGTHS = (4, 5, 6, 7, 8)
STOP = ".!?;\n"
LEXICAL = "ikmynrbo"
#: What the machine writes, by event.
EVENTS = {
    "X": "plain", "Y": "targeted", "+": "targeted_after", "N": "negated", "R": "reported",
    "K": "threat", "V": "violent", "T": "threat_targeted", "t": "threat_targeted_after", "M": "threat_muted",
}
OUTPUTS = list(EVENTS.values())
#: How much the number of clauses weakens what matched among them.
LENGTH_POWER = 0.5

Arcs = dict[tuple[str, str], tuple[str, str, float]]


def transducer(states: list, alphabet: str, step) -> Arcs:
    """Arcs of a deterministic transducer: ``step(state, symbol)`` is (next state, what is written, weight)."""
    return {(str(q), x): (str(to), y, w) for q in states for x in alphabet for to, y, w in [step(q, x)]}


def insult() -> Arcs:
    """An insult (i) is written as X; one right after another weighs half as much again."""
    return transducer([0, 1], LEXICAL, lambda q, x: (1, "X", 1.5 if q else 1.0) if x == "i" else (0, x, 1.0))


def threat(reach: int = 3) -> Arcs:
    """A violent verb (k) within ``reach`` words of an intention (m) is a threat K, another one mere violence V."""

    def step(left, x):
        if x == "k":
            return 0, "K" if left else "V", 1.0 if left else 0.5
        return reach if x == "m" else max(0, left - 1), x, 1.0

    return transducer(list(range(reach + 1)), "X" + LEXICAL[1:], step)


def negation(reach: int = 3) -> Arcs:
    """Within ``reach`` words of a negation, insults become N and threats M, at a quarter of the weight."""

    def step(left, x):
        if left and x in "XKV":
            return left - 1, "N" if x == "X" else "M", 0.25
        return reach if x == "n" else 0 if x == "b" else max(0, left - 1), x, 1.0

    return transducer(list(range(reach + 1)), "XKVmynrbo", step)


def reported() -> Arcs:
    """From a reporting verb to a contrast word, insults become R and threats M, at half the weight."""

    def step(inside, x):
        if inside and x in "XNKVM":
            return 1, "R" if x in "XN" else "M", 0.5
        return 1 if x == "r" else 0 if x == "b" else inside, x, 1.0

    return transducer([0, 1], "XNKVMmynrbo", step)


def target(before: int = 4, after: int = 3) -> Arcs:
    """A target up to ``before`` words before an insult or threat makes it Y or T; one up to ``after`` words after it adds + or t."""

    def step(state, x):
        left, kind, right = state
        kind, right = (kind, right - 1) if right > 1 else ("", 0)
        if x == "y":
            return (before, "", 0), "+" if state[1] == "X" else "t" if state[1] else "y", 1.0
        if x in "XKV":
            marked = "Y" if x == "X" else "T"
            return (max(0, left - 1), "" if left else "X" if x == "X" else "K", 0 if left else after), marked if left else x, 2.0 if left else 1.0
        return (max(0, left - 1), kind, right), x, 1.0

    states = [(left, kind, right) for left in range(before + 1) for kind, right in [("", 0), *product("XK", range(1, after + 1))]]
    return transducer(states, "XNRKVMmynrbo", step)


def compose(first: Arcs, second: Arcs) -> Arcs:
    """The machine that passes what ``first`` writes on to ``second``; weights of arcs multiply."""
    arcs: Arcs = {}
    states = {q for q, _ in second}
    for (a, x), (to, y, w) in first.items():
        for b in states:
            b_to, z, v = second[b, y]
            arcs[f"{a}/{b}", x] = (f"{to}/{b_to}", z, w * v)
    return arcs


def grammar() -> tuple[Arcs, str]:
    """The five transducers composed, and the state in which a clause begins."""
    arcs = insult()
    for part in (threat(), negation(), reported(), target()):
        arcs = compose(arcs, part)
    return arcs, "/".join(("0", "0", "0", "0", str((0, "", 0))))


class Lexicon(dict):
    """Class of each word; stems of insults accept every word that begins with them."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.seed = float(np.median(list(stems.values()))) if stems else 1.0
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.fixed = {}
        for words, symbol in ((INSULTS, "i"), (VIOLENT, "k"), (INTENTIONS, "m"), (TARGETS, "y"), (NEGATIONS, "n"), (REPORTED, "r"), (CONTRASTS, "b"), (STOP, ".")):
            self.fixed.update(dict.fromkeys(words, symbol))

    def weight(self, word: str) -> float:
        """Of the longest stem that the word begins with, else of a seed word."""
        found = next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), None)
        return self.seed if found is None and self.fixed.get(word) == "i" else found or 0.0

    def __missing__(self, word: str) -> str:
        if len(self) > 400_000:
            self.clear()
        symbol = self[word] = self.fixed.get(word) or ("i" if self.weight(word) else "o")
        return symbol


class Machine:
    """Reads texts with the composed grammar."""

    def __init__(self, stems: dict[str, float]):
        self.lexicon = Lexicon(stems)
        self.arcs, self.begin = grammar()

    def clause(self, symbols: str, words: list[str]) -> dict[str, float]:
        """Events of a clause, each with its heaviest weight: of the arc, times that of the word's stem or of a seed word."""
        state, out, last = self.begin, {}, self.lexicon.seed
        for s, word in zip(symbols, words, strict=True):
            state, event, weight = self.arcs[state, s]
            if name := EVENTS.get(event):
                if s == "i":
                    last = self.lexicon.weight(word)
                elif s == "k":
                    last = self.lexicon.seed
                out[name] = max(out.get(name, 0.0), weight * last)
        return out

    def clauses(self, words: list[str]) -> tuple[list[tuple[int, int, dict[str, float]]], int]:
        """First and last word (exclusive) and events of each matched clause, and the number of clauses."""
        symbols = "".join(map(self.lexicon.__getitem__, words))
        parts, out, at = symbols.split("."), [], 0
        if "i" in symbols or "k" in symbols:
            for part in parts:
                if ("i" in part or "k" in part) and (events := self.clause(part, words[at : at + len(part)])):
                    out.append((at, at + len(part), events))
                at += len(part) + 1
        return out, sum(map(bool, parts))

    def load(self, text: str | None) -> float:
        """Weight of the matched clauses over a root of the number of clauses."""
        found, n = self.clauses(TOKEN.findall(text.lower()) if text else [])
        return sum(sum(events.values()) for *_, events in found) / max(1, n) ** LENGTH_POWER


def stem_counts(sample: DataFrame) -> DataFrame:
    """stem, toxic, clean: documents of each label with a word that begins with the stem; counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = {w for w in TOKEN.findall((text or "").lower()) if len(w) > 3}
                counts[label].update({w[:n] for w in words for n in LENGTHS if n <= len(w)} | words)
        stems = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(stems), 50_000):
            part = stems[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([counts[v][s] for s in part], pa.int64()) for v in (1, 0))], ["stem", "toxic", "clean"])

    return sample.select("text", F.col("label").cast("long").alias("label")).mapInArrow(run, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_stems(sample: DataFrame, ratio: float = 20.0, least: float = 0.01, most: int = 2000) -> dict[str, float]:
    """Stems and their weights (log of the ratio of shares), the most telling first, none an extension of another.

    A stem stands in ``least`` of the toxic documents at least, ``ratio`` times its share of the others: rarer ones are chance.
    """
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}
    p, q = F.col("toxic") / toxic, (F.col("clean") + 0.5) / clean
    told = F.col("toxic") * F.log(p / q)
    rows = stem_counts(sample).where((F.col("toxic") >= max(4, least * toxic)) & (p >= ratio * q)).select("stem", F.log(p / q).alias("weight"), told.alias("told"))
    out: dict[str, float] = {}
    for r in rows.orderBy(F.desc("told"), F.desc(F.length("stem")), "stem").limit(most).collect():
        s = r["stem"]
        if not any(s.startswith(x) or x.startswith(s) for x in out):
            out[s] = r["weight"]
    return out


def load_udf(stems: dict[str, float]):
    def make():
        machine = Machine(stems)
        return lambda texts: [[machine.load(t) for t in texts]]

    return text_udf({"load": "double"}, make)


def toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> dict:
    """Stems, scale and level; documents whose crc32 of the id leaves 1 on division by 3 are never learned from."""
    keep = crc_mod("doc_id", 3) != 1
    shares = {r["toxic"]: r["count"] for r in labels.where(keep & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    if len(shares) < 2:
        return {"stems": {}, "weights": None, "share": float(shares.get(1, 0) > 0)}
    sample = labelled_sample(docs, labels, "toxic", keep, per_class)
    stems = learn_stems(sample)
    rows = in_order(sample.select("doc_id", "label", load_udf(stems)("text").alias("f")).select("doc_id", "label", "f.*").collect())
    if len({r["label"] for r in rows}) < 2:
        return {"stems": {}, "weights": None, "share": shares[1] / sum(shares.values())}
    x, y = np.array([[r["load"]] for r in rows]), np.array([r["label"] for r in rows])
    weight = np.array([shares[v] / max(1, (y == v).sum()) for v in (0, 1)])[y.astype(int)] * len(y) / sum(shares.values())
    scale, level = logistic(x, y, weight, ridge=0.01)
    return {"stems": stems, "weights": np.array([max(0.0, scale), level]), "share": shares[1] / sum(shares.values())}


def score_of(model: dict):
    """Probabilities of toxic for texts, from the events of their matched clauses."""

    def score(machine: Machine, texts: list[str | None]) -> np.ndarray:
        if model["weights"] is None or not texts:
            return np.full(len(texts), model["share"])
        scale, level = model["weights"]
        return 1 / (1 + np.exp(-np.clip(scale * np.array([machine.load(t) for t in texts]) + level, -30, 30)))

    return score


def scorer(model: dict):
    """An Arrow UDF: probability of toxic."""

    def make():
        machine, score = Machine(model["stems"]), score_of(model)
        return lambda texts: [score(machine, texts)]

    return lambda text: text_udf({"p": "double"}, make)(text)["p"]


def find_toxic_clauses(docs: DataFrame, model: dict) -> DataFrame:
    """Add toxicity and, for each matched clause, clause_starts and clause_ends (code points, end exclusive), clause_events
    (joined by +) and clause_weights to every row of ``docs``."""
    fields = {"toxicity": "double", "clause_starts": "array<int>", "clause_ends": "array<int>", "clause_events": "array<string>", "clause_weights": "array<double>"}

    def make():
        machine, score = Machine(model["stems"]), score_of(model)

        def run(texts: list[str | None]) -> list[list]:
            rows = []
            for text in texts:
                spans = [m.span() for m in TOKEN.finditer(text)] if text else []
                found, _ = machine.clauses([text[s:e].lower() for s, e in spans])
                rows.append(([spans[i][0] for i, _, _ in found], [spans[j - 1][1] for _, j, _ in found], ["+".join(e) for *_, e in found], [sum(e.values()) for *_, e in found]))
            return [list(score(machine, texts)), *map(list, zip(*rows, strict=True))] if rows else [[] for _ in fields]

        return run

    return with_struct(docs, "_tox", text_udf(fields, make)("text"), list(fields))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
