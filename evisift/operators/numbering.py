"""Dense numbers for values, given out over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisift.session import materialize


def dense_ids(values: DataFrame, column: str, name: str) -> DataFrame:
    """``values`` (distinct in ``column``) with ``name``: 0, 1, 2, ... in the order of the column.

    Rows are sorted by ranges; a row's number is its place in its range plus the sizes of the ranges before.
    """
    ranged = materialize(values.repartitionByRange(column).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return ranged.withColumn("_place", place).join(offsets, "_range").select(*values.columns, (F.col("_before") + F.col("_place")).alias(name))
