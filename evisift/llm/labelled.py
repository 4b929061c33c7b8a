"""Labelled rows for fitting: held-out folds by check sum and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled rows that a classifier is fitted on at most; they are those with the smallest id hashes.
FIT_ROWS = 20_000


def fold(key: Column, folds: int) -> Column:
    """Fold of an id by the check sum of its text; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, *, key: str, text: str, rows: int
) -> DataFrame:
    """At most ``rows`` texts with label 0 or 1, none of them held out: doc_id, body, label.

    Null ids and labels don't count; of repeated labels the largest does, of repeated ids every text.
    """
    usable = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & ~held_out
    )
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return source.join(F.broadcast(chosen), "doc_id")  # no more than ``rows`` rows
