"""Small document tables with the awkward cases: nulls, empty, repeated, long, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n)]


def table(spark, texts, first: int = 0, schema: str = SCHEMA):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)], schema)


AWKWARD = [None, "", " \n\t ", "one", "two words", "é" * 50, "x " * 3000, "same text here", "same text here", "  wide spaces　", "🙂 🙂 🙂", "a\r\nb\x0bc\x0cd"]
