"""Quality rules by weak supervision: rules vote good, bad or abstain, and EM weighs them.

One pass over the texts measures what the rules look at. The votes of a document form a pattern; as there are
three votes for each of RULES, at most 3 ** len(RULES) patterns exist, whatever the number of documents, and few of
them occur. Their counts, over all documents, go to the driver, where expectation-maximisation estimates the share of
good documents and, for each rule and class, how often it votes good, bad or not at all. The posterior of each pattern
then goes back by a broadcast join of the same bounded size.

The posterior replaces the demand that every rule passes. Nothing but agreement tells how far a rule is to be believed:
a rule whose bad votes come alone while all others vote good turns out to be a poor witness, and its vote is overruled;
rules that fire together confirm each other, and where several of them abstain a document may be refused without any
bad vote. Rules therefore overlap on purpose: several look at each fault from different sides.

Defined results: a null, empty or wordless text has all counts 0, every rule abstains, and base_failed is true; whole
texts are measured in memory that grows with the one text; repeated rows and ties get equal results; an empty table gives
no rows; columns of the input beside doc_id and text, whatever their names, are not carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, read, text_udf, with_struct

MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_lines": "long", "n_upper": "long", "n_marks": "long", "n_distinct_words": "long", "n_alpha_words": "long",
    "n_clean_words": "long", "n_common_words": "long",
}
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
CAPITALS = bytes(range(65, 91))
EDGES = ".,;:!?\"'()¿¡«»-"
#: Function words of four languages.
COMMON = frozenset(
    "the of and to in a is was that for with as by on at be are or it he not this from der die das und den von zu mit ist nicht ein eine auf"
    " für im dem sich des auch als de la que el en y los del se las por con una un le les et une du pour dans est pas au sur".split()
)


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    repeated = 0
    if n >= 3:
        k = len(number)
        pair = ids[:-1] * k + ids[1:]
        if k >= 2_000_000:  # three ids wouldn't fit into 63 bits: number the pairs first
            pair, k = np.unique(pair, return_inverse=True)[1].astype(np.int64), len(number)
        window = pair[:-1] * k + ids[2:]
        _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[inverse] > 1)
        covered = np.zeros(n, bool)
        for j in range(3):
            covered[starts + j] = True
        repeated = int(covered.sum())
    upper = len(raw) - len(raw.translate(None, CAPITALS))
    starts_alpha = np.fromiter((w[:1].isalpha() or w[0] >= 128 for w in number), bool, len(number))
    seen = np.bincount(ids, minlength=len(number))
    bare = [w.decode(errors="replace").strip(EDGES).lower() for w in number]
    clean = np.fromiter((w.isalnum() or w.replace("-", "").replace("'", "").isalnum() for w in bare), bool, len(bare))
    common = np.fromiter((w in COMMON for w in bare), bool, len(bare))
    return (
        n, chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated,
        len(lines), upper, sum(text.count(c) for c in MARKS), len(number),
        *(int(seen[x].sum()) for x in (starts_alpha, clean, common)),
    )


def measured():
    return lambda texts: list(map(list, zip(*map(measure, texts), strict=True))) if texts else [[] for _ in MEASURES]


#: (name, fault it tells of, bad if, good if) over MEASURES; a rule abstains where neither holds, and wherever there are under
#: 20 words.
RULES = [
    ("length", "form", "n_words < 60", "n_words >= 120"),
    ("word_length", "form", "word_chars > 14 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    ("symbols", "noise", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("repeated_lines", "repetition", "3 * n_dup_lines > n_lines", "10 * n_dup_lines <= n_lines"),
    ("repetition", "repetition", "5 * n_repeat_words > 2 * n_words", "20 * n_repeat_words <= n_words"),
    ("capitals", "form", "3 * n_upper > word_chars", "8 * n_upper <= word_chars"),
    ("marks", "noise", "10 * n_marks > n_words", "50 * n_marks <= n_words"),
    ("variety", "repetition", "100 * n_distinct_words < 15 * n_words", "n_words < 2000 and 100 * n_distinct_words > 35 * n_words"),
    ("letters", "noise", "100 * n_alpha_words < 60 * n_words", "100 * n_alpha_words > 85 * n_words"),
    ("clean_words", "noise", "100 * n_clean_words < 70 * n_words", "100 * n_clean_words > 90 * n_words"),
    ("common_words", "noise", "100 * n_common_words < 5 * n_words", "100 * n_common_words > 12 * n_words"),
]


def votes() -> F.Column:
    """One letter a rule: b(ad), g(ood) or - (abstains)."""
    return F.concat(*[F.when(F.col("n_words") < 20, "-").when(F.expr(bad), "b").when(F.expr(good), "g").otherwise("-") for _, _, bad, good in RULES])


#: Counts of bad votes, good votes and abstentions that stand for ignorance: of a rule in the class of its own fault, and
#: elsewhere. Rules are taken to be somewhat better than chance until the documents say otherwise.
OWN, ELSEWHERE = (2.0, 2.0, 1.0), (1.0, 4.0, 1.0)


def estimate(patterns: list[tuple[str, int]], faults: list[str] | None = None, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns and their counts: shares of the classes, rates (class, rule, vote) and posteriors (pattern, class).

    The first class is good, the others are the kinds of ``faults`` (one a rule; by default those of RULES). EM starts from
    the share of good among each pattern's votes, the rest dealt to the faults that were voted for. No bound holds any rate:
    the prior counts weigh as much as a few documents.
    """
    faults = faults or [f for _, f, _, _ in RULES]
    kinds = sorted(set(faults))
    own = np.array([[False] * len(faults), *([f == k for f in faults] for k in kinds)])
    prior = np.where(own[:, :, None], OWN, ELSEWHERE)
    code = {"b": 0, "g": 1, "-": 2}
    votes = np.array([[code[c] for c in p] for p, _ in patterns])
    count = np.array([n for _, n in patterns], float)
    one = np.eye(3)[votes]
    good = (1 + (votes == 1).sum(1)) / (2 + (votes != 2).sum(1))
    voted = 0.1 + (votes == 0) @ own[1:].T
    q = np.column_stack([good, (1 - good)[:, None] * voted / voted.sum(1, keepdims=True)])
    for _ in range(rounds):
        weight = q * count[:, None]
        share = (weight.sum(0) + 1) / (count.sum() + q.shape[1])
        rate = np.einsum("pc,prv->crv", weight, one) + prior
        rate /= rate.sum(2, keepdims=True)
        log = np.log(share) + np.einsum("prv,crv->pc", one, np.log(rate))
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        change, q = np.abs(new - q).max(), new
        if change < 1e-9:
            break
    return share, rate, q


def fit(patterns: list[tuple[str, int]], faults: list[str] | None = None) -> dict[str, float]:
    """The posterior probability of good for each pattern."""
    return {p: float(x) for (p, _), x in zip(patterns, estimate(patterns, faults)[2][:, 0], strict=True)} if patterns else {}


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add MEASURES, votes, probability, base_failed and kept to doc_id of every row of ``docs`` (doc_id, text).

    Only these columns are carried: they are written once to the shared folder, as the votes are counted over all
    documents before any gets its posterior.
    """
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    rows = with_struct(rows, "_m", text_udf(MEASURES, measured)("_text"), list(MEASURES)).drop("_text")
    rows = materialise(rows.withColumn("votes", votes()), "rules")
    counted = [(r["votes"], r["count"]) for r in rows.groupBy("votes").count().collect()]  # at most 3 ** len(RULES) rows
    posterior = sorted(fit(sorted(counted)).items())
    table = docs.sparkSession.createDataFrame(posterior, "votes string, probability double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rows.join(F.broadcast(table), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return score_quality(read(spark, sf_dir, "documents")).select("doc_id", *names, "base_failed", "kept", "votes", "probability")
