"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark
items go, secrets are blanked out, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and all its predecessor kept; all but the last return the columns of documents, further columns
included. In every stage null and empty texts are documents without words: they are not toxic unless the classifier's intercept says so,
have no near-duplicates, hold no item and no secret, and have no pieces. Texts are read whole, however long. Rows without an id stay in
every stage. Rows that repeat id and text are one document to the near-duplicate stage, of which one row stays; the other stages treat them
alike. Of equally similar documents the smallest id stays. An empty table gives an empty table. Nothing is read from columns other than
doc_id and text (n_chars follows where a text changes), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromaweft.llm import decontamination, jaccard_join, secret_scan, sp_codec, toxicity
from chromaweft.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 (operator 5). Without labels, or without toxic ones, all stay."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class at similarity 0.8 of five-word shingles (operator 3)."""
    return jaccard_join.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to 0.8 of its shingles (operator 2). Items of fewer than five words are found nowhere."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets replaced by a mark (operator 1); overlapping ones by one mark. Null texts stay null."""
    return secret_scan.redact(docs, secret_scan.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document (operator 4): packed 16-bit ids, their number and digest, and whether they decode to the text; null counts as empty."""
    return sp_codec.encode_documents(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", blank_secrets),
    ("encoding", encode),
]

#: The classifier and the encoder cannot be put in SQL; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
