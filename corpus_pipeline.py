"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import bpe, decontaminate, jaccard, quality_rules, secrets
from residua.llm.common import discard, shared_dir, table
from residua.llm.queries import tokenizer_file


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return jaccard.one_of_each_group(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.redact_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of each document, with its number of tokens."""
    return bpe.encode_words(docs, tokenizer_file("word_bpe_49k.json")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", good_documents),
    ("jaccard_join", one_of_each_group),
    ("decontamination", clean_of_benchmarks),
    ("secret_scans", without_secrets),
    ("bpe_codec", encoded),
]
#: Components of near copies are a closure that SQL on whole tables is too slow for; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes when its successor is there.

    The last one's files go when the JVM ends.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)
        before = f"{folder}/{name}"
    discard(spark, folder, at_exit=True)
    return docs
