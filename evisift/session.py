"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "evisift", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        # adaptive execution turns a sort-merge join into a hash join once it has seen that
        # every shuffled partition of one side is small
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "48m")
        # joins here expand their input many times over, so small shuffles keep their parallelism
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the one the cluster names, or a fresh one in local tests."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str, *, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    The plan is computed a single time, later readers get column pruning and pushed
    filters, and a lost executor re-reads files instead of replaying the lineage.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
