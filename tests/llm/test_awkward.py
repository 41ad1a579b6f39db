"""Every operator on nulls, empty texts, repeats, clashing columns and empty tables: defined results, no failure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import AWKWARD, SCHEMA, table
from tidemark.llm import byte_cnn, decontaminate, jaccard_join, licenses, packing, pii, quality_rules, secrets, tokens, toxicity

N = len(AWKWARD)


@pytest.fixture(scope="module", params=["awkward", "empty"])
def docs(request, spark):
    df = table(spark, AWKWARD).unionByName(spark.createDataFrame([(None, None, None, None, None), (3, "repeated id", "en", "s", 1)], SCHEMA))
    df = df.where("false") if request.param == "empty" else df
    for c in ("score", "label", "n_words", "hit_starts", "node", "votes", "component_id", "p", "kinds"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)] + [(None, 1, None)], "doc_id long, quality int, toxic int")


def test_quality_rules(docs):
    out = quality_rules.score_quality(docs).collect()
    assert len(out) == docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in out if r["n_words"] < 50)


def test_licenses(docs):
    assert licenses.find_licenses(docs).count() == 0


def test_pii(docs):
    model = pii.pii_model(docs, documents=50, made=400)
    assert pii.find_pii(docs, model).where("size(pii_kinds) > 0").count() == 0


def test_toxicity(docs, labels):
    out = docs.select("doc_id", toxicity.scorer(toxicity.toxicity_model(docs, labels))("text").alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in out) and len(out) == docs.count()


def test_packing(docs):
    out = packing.pack_documents(packing.token_lengths(docs, tokens.byte_bpe())).collect()
    assert len(out) >= docs.count()


def test_jaccard(docs):
    out = jaccard_join.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    groups = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    if groups:
        assert groups[8] == 7 and groups[0] == 0 and groups[1] == 1
        assert {r["n_shingles"] for r in out if r["doc_id"] in (0, 1, 2)} == {0}


def test_records(docs, spark, tmp_path):
    folder = str(tmp_path / "records")
    out = tokens.read_records(tokens.write_records(docs, tokens.byte_bpe(), folder), folder).collect()
    assert len(out) == docs.count()
    assert all(r["n_tokens"] >= 1 and r["ids"][-1] == 0 for r in out)


def test_byte_cnn(docs, labels):
    model = byte_cnn.fit(docs, labels, "quality", F.lit(True), per_class=20)
    assert all(0 <= r["s"] <= 1 for r in docs.select(byte_cnn.scorer(model)("text").alias("s")).collect())


def test_decontaminate(docs, spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "one"), (4, "two words")], "item_id long, text string")
    out = decontaminate.find_contamination(docs, bench)
    assert out.where("contaminated").count() == (1 if docs.count() else 0)
    assert {"score", "n_words", "contaminated"} <= set(out.columns)


def test_secrets(docs):
    model = secrets.train(secrets.synthetic(60), rounds=2)
    assert secrets.find_secrets(docs, model).where("size(secret_kinds) > 0").count() == 0


def test_samples_count_an_id_once_and_models_ignore_partitioning(spark, data):
    from tidemark.llm import byte_cnn, common, toxicity

    docs, labels = common.read(spark, data, "documents"), common.read(spark, data, "labels")
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.lit("~"), "text")))
    sample = common.labelled_sample(twice, labels, "toxic", F.lit(True), 20)
    assert sample.count() == sample.select("doc_id").distinct().count() <= 40
    assert sample.where("text like '~%'").count() == 0
    a, b = (toxicity.toxicity_model(docs.repartition(n), labels) for n in (2, 7))
    assert a["stems"] == b["stems"] and np.array_equal(a["weights"], b["weights"])
    a, b = (byte_cnn.fit(docs.repartition(n), labels, "quality", F.lit(True), per_class=60) for n in (2, 7))
    assert np.array_equal(a["combine"], b["combine"])
