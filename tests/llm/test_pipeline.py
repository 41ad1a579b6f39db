"""The pipeline's stages, one after the other, against plain Python."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_brute_force import components_by_hand
from tidemark.llm import secrets
from tidemark.llm.common import materialise


def test_stages(spark, data):
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in cp.STAGES:
        before = docs
        docs = materialise(stage(spark, before, data), "t")
        seen.append((name, before, docs))
        if name != "best-fit packing":
            assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes)
    (_, raw, kept), (_, _, single), (_, _, clean), (_, _, safe), (_, _, packed) = seen
    assert 0 < kept.count() < raw.count()
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    group = components_by_hand([t for _, t in rows])
    assert {r["doc_id"] for r in single.collect()} == {rows[g][0] for g in group}
    assert clean.count() <= single.count() and safe.count() == clean.count()
    assert not any(secrets.base_spans(r["text"]) for r in safe.collect())
    assert safe.where(F.col("n_chars") != F.length("text")).count() == 0
    assert packed.select("doc_id").distinct().count() == safe.count()


def test_run_is_the_last_stage(spark, data):
    out = cp.run(spark, data)
    assert out.columns == ["doc_id", "piece", "start", "n_tokens", "bin", "capacity", "offset"] and out.count() > 0


def test_redaction_in_place():
    assert cp.without("x token = abcdef y", [(2, 16, "assign")]) == "x [secret] y"
    assert cp.without("abcdef", [(0, 4, "a"), (2, 5, "b")]) == "[secret]f"


def test_repeated_rows_stay_once(spark, data):
    a, b = "one text of some six words here", "another text that is not like it"
    rows = [(3, b), (5, a), (5, a), (5, b), (7, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, docs, data).collect()) == [(3, b), (5, a)]


def test_stages_on_awkward_rows(spark, data):
    """Nulls, empty and repeated rows, clashing names and empty tables go through every stage."""
    texts = [None, "", " ", "x " * 3000, "same text here", "same text here", "password = abcdef12"]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)] + [(None, None, None, None, None), (4, texts[4], "en", "s", 14)]
    whole = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("node", "component", "_node", "_key", "items", "n_words", "secret_kinds"):
        whole = whole.withColumn(c, F.lit("clash"))
    for name, stage in cp.STAGES[1:]:
        docs = materialise(stage(spark, whole, data), "t")
        assert stage(spark, whole.where("false"), data).count() == 0
        if name != "best-fit packing":
            assert docs.columns == whole.columns and {r["node"] for r in docs.collect()} == {"clash"}
        if name == "secret scan":
            assert [r["text"] for r in docs.where("doc_id = 6").collect()] == ["[secret]"]
        assert docs.where("doc_id is null").count() == 1
