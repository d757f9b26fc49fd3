"""A training-data pipeline over ``documents``: STAGES in order, each applying one operator.

Every stage reads all that its predecessor kept, as a written table, and all but the
last return the columns of documents.  ORACLE_SQL is None, as SQL cannot express the
language model, the compressor or the tokenizer; tests compare run() with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import decontaminate, langid, minhash, pieces, secret_scan
from bindery.llm.common import crc_of_id, small_batches, table
from bindery.session import settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not found or rejected; learns from those not held out."""
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs.where(crc_of_id() % 5 != 0)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group that shares 80 % of its five-word shingles."""
    small_batches(spark)
    return minhash.keep_one(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half of a benchmark item or more."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in texts; all documents stay."""
    small_batches(spark)
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document with its columns, and how many there are."""
    small_batches(spark)
    found = docs.withColumn("_", pieces.encoded(docs["text"]))
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_tokens", "text", "decoded")]
    return found.select(*names, F.col("_.ids").alias("ids"), F.size("_.ids").cast("bigint").alias("n_tokens"), F.col("_.decoded").alias("decoded"))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("secrets", mask_secrets),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
