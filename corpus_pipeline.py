"""Corpus preparation: quality, exact copies, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and reads further tables under ``sf_dir``. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm import decontaminate, exact_dedup, jaccard, quality, tokens
from evisift.llm.registry import table
from evisift.session import checkpoint_dir


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality model, fitted on the labelled ones among them, doesn't reject."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id."""
    return jaccard.drop_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's passages; ``n_chars`` follows the text."""
    cleaned = decontaminate.remove_passages(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" not in docs.columns:
        return cleaned
    changed = F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", changed)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in windows of tokens."""
    return tokens.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", good_texts),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", one_per_group),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]
# The quality model and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
