"""Review files and multi-output writers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(column: Column) -> Column:
    """Text a spreadsheet would run as a formula gets a leading quote."""
    return F.when(F.ltrim(column).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), column)).otherwise(column)


def guard_text(df: DataFrame) -> DataFrame:
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[guarded(F.col(c)).alias(c) if c in strings else F.col(c) for c in df.columns])


def write_review_csv(df: DataFrame, path: str) -> None:
    """CSV for reviewers; an existing file is never replaced."""
    guard_text(df).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_outputs(outputs: dict[str, tuple[DataFrame, str]], folder: str) -> None:
    """Several results below one folder as ``json`` or ``csv``."""
    for name, (df, kind) in outputs.items():
        path = os.path.join(folder, name)
        if kind == "csv":
            write_review_csv(df, path)
        else:
            df.write.mode("errorifexists").json(path)


def review_workbook(records: DataFrame, sources: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per record with its source and the reviewers of exactly this version.

    ``records(item_id, item_type, item_sha256, source_artifact_id, ...)``.
    """
    said = reviews.groupBy("item_type", "item_id", "item_sha256").agg(
        F.array_join(
            F.array_sort(F.collect_set(F.concat_ws(":", "reviewer_id", "decision"))), ", "
        ).alias("reviewed_by")
    )
    source = sources.select(F.col("artifact_id").alias("source_artifact_id"), "source_url", "release")
    return (
        records.join(source, "source_artifact_id", "left")
        .join(said, ["item_type", "item_id", "item_sha256"], "left")
        .withColumn("reviewed_by", F.coalesce("reviewed_by", F.lit("")))
    )
