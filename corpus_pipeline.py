"""Corpus pipeline: quality, near duplicates, benchmark contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet into the shared folder and
reads again as the next stage's docs. All but the last return the columns of ``documents``.

Defined results: a null or empty text is scored by the classifier like any other; kept, it is a group of its own, has no
benchmark words and no secrets, stays null, and is packed as a piece without tokens. Whole texts are worked on. Rows that repeat
an id and a text stay once from the second stage on; of documents that tie in a group the smallest id stays. Empty tables
give empty results; other columns of documents pass through all stages but the last, and those whose names a stage would use
within keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_cnn, decontaminate, jaccard_join, packing, secrets
from tidemark.llm.common import materialise, read, text_udf, with_struct
from tidemark.llm.tokens import byte_bpe


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which the byte-level network gives a probability of 0.3 or more."""
    model = byte_cnn.quality_model(docs, read(spark, sf_dir, "labels"))
    return docs.withColumn("_quality", byte_cnn.scorer(model)("text")).where("_quality >= 0.3").drop("_quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of similar documents, and all that link with none; a repeated row stays once."""
    return jaccard_join.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth of the words."""
    slim = decontaminate.find_contamination(docs.select(F.struct(*docs.columns).alias("_row"), "text"), read(spark, sf_dir, "benchmark"))
    return slim.where("not contaminated").select("_row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by [secret] and n_chars counted anew."""
    model = secrets.secret_model(docs)

    def make():
        field = secrets.Field(model)
        return lambda texts: [[None if t is None else without(t, secrets.scan(t, field)) for t in texts]]

    clean = text_udf({"text": "string"}, make)("text")
    columns = docs.columns
    done = with_struct(docs, "_clean", clean, ["text"])
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*columns)


def without(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in bins of the permitted sequence lengths."""
    return packing.pack_documents(packing.token_lengths(docs, byte_bpe()))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("best-fit packing", pack),
]
#: The classifier, the field and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
