"""Snapshot tables, hashes and manifests."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.functions import ids

ROW_GROUP_BYTES = 64 * 1024 * 1024
# Redistribution terms from least to most restrictive.
REDISTRIBUTION = ("allowed_with_attribution", "restricted", "prohibited")
HASH_PREFIXES = (6, 3, 0)


def write_tables(tables: dict[str, DataFrame], folder: str, keys: dict[str, str]) -> None:
    """Each table as ZSTD Parquet, range-partitioned and sorted by its id."""
    for name, df in tables.items():
        key = keys[name]
        (
            df.repartitionByRange(key).sortWithinPartitions(key)
            .write.mode("errorifexists").option("compression", "zstd")
            .option("parquet.block.size", ROW_GROUP_BYTES)
            .parquet(os.path.join(folder, name))
        )


def read_tables(
    spark: SparkSession, folder: str, schemas: dict[str, str], expected: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Read the tables; with expected logical hashes a changed table is refused."""
    tables = {
        name: spark.read.schema(schema).parquet(os.path.join(folder, name)) for name, schema in schemas.items()
    }
    for name, digest in (expected or {}).items():
        actual = table_hash(tables[name]).first()["logical_sha256"]
        if actual != digest:
            raise ValueError(f"table {name} does not match its recorded hash")
    return tables


def table_hash(df: DataFrame, prefixes: tuple[int, ...] = HASH_PREFIXES) -> DataFrame:
    """Row count and logical hash, independent of file layout.

    Rows are digested one by one and the digests combined as a tree over their leading hex
    digits. Every level joins at most 16**3 sorted child digests, the lowest one the rows that
    share six digits, so no group grows with the table beyond rows / 16**6.
    """
    columns = sorted(df.columns)
    # digests move as bytes, whose order is that of their hex digits
    sha = df.select(ids.row_sha(*columns).alias("sha"))
    length, *rest = prefixes
    level = sha.select(F.left("sha", F.lit(length)).alias("at"), F.unhex("sha").alias("h")).groupBy("at").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda x: F.lower(F.hex(x))), ""), 256).alias("h"),
        F.count("*").alias("n"),
    )
    for length in rest:
        level = level.groupBy(F.left("at", F.lit(length)).alias("at")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256)
            .alias("h"),
            F.sum("n").alias("n"),
        )
    return level.select(F.col("n").alias("rows"), F.col("h").alias("logical_sha256"))


def content_hash(hashes: DataFrame, scope: str, rules: str) -> DataFrame:
    """One hash over the table hashes with the scope and rules; ``hashes(table, logical_sha256)``."""
    listed = F.array_sort(F.collect_list(F.struct("table", "logical_sha256")))
    return hashes.agg(
        F.sha2(F.to_json(F.struct(listed.alias("tables"), F.lit(scope).alias("scope"), F.lit(rules).alias("rules"))), 256)
        .alias("content_sha256")
    )


def redistribution_rank(value: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in REDISTRIBUTION]), value)


def most_restrictive(sources: DataFrame) -> DataFrame:
    """Redistribution of the whole is the most restrictive of its sources."""
    return sources.agg(F.max(redistribution_rank(F.col("redistribution"))).alias("r")).select(
        F.element_at(F.array(*[F.lit(x) for x in REDISTRIBUTION]), F.col("r").cast("int")).alias("redistribution")
    )


def family_manifest(families: DataFrame, members: DataFrame) -> DataFrame:
    """Every family with its dependency type and number of members."""
    sizes = members.groupBy("family").agg(F.count("*").alias("members"))
    return families.join(sizes, "family", "left").select("family", "dependency_type", F.coalesce("members", F.lit(0)).alias("members"))


def family_summary(families: DataFrame) -> DataFrame:
    """Number of families per dependency type."""
    return families.groupBy("dependency_type").agg(F.count("*").alias("families"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(name, sha256)`` of every file under a path."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    )


def checksum_violations(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected artifacts that are missing or differ; both frames are ``(name, sha256)``."""
    joined = expected.select("name", F.col("sha256").alias("expected")).join(actual, "name", "left")
    return joined.filter(~F.col("sha256").eqNullSafe(F.col("expected"))).select(
        "name", F.when(F.col("sha256").isNull(), "missing").otherwise("checksum").alias("problem")
    )


def rebuild_differences(rebuilt: DataFrame, pinned: DataFrame) -> DataFrame:
    """Rows only one of the two builds has."""
    columns = pinned.columns
    both = rebuilt.select(*columns, F.lit(1).alias("more")).unionByName(pinned.select(*columns, F.lit(-1).alias("more")))
    more = both.groupBy(*columns).agg(F.sum("more").alias("more")).filter("more <> 0")
    times = F.explode(F.sequence(F.lit(1), F.abs("more")))
    return more.select(*columns, F.when(F.col("more") > 0, "rebuilt").otherwise("pinned").alias("side"), times.alias("time")).drop("time")
