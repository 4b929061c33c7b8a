"""Running totals in groups of any size: a hot group is spread over many tasks.

Rows are dealt by ranges of (group, order), so a group with a third of all rows lies in many parts that follow
each other. Totals run inside a part, and what the earlier parts of a group hold is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.session import materialize


def running(rows: DataFrame, group: list[str], order: list[Column], totals: dict[str, Column], label: str) -> DataFrame:
    """``rows`` with, for each name in ``totals``, the aggregate over the rows before it in its group; 0 at the first.

    ``totals`` are sums, counts or ``bit_xor`` over columns of ``rows``. Nulls in ``group`` are a group of their own.
    Rows that tie in ``order`` are taken in any order; make it unique where that matters.
    """
    keys = [F.col(c) for c in group]
    placed = materialize(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), label)
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_part")
    parts = placed.groupBy("_part", *group).agg(*(total.alias(name) for name, total in totals.items()))
    add = {name: F.bit_xor if "bit_xor" in str(total) else F.sum for name, total in totals.items()}
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    # a part's border runs through one group at most, so there are fewer of these rows than parts
    carried = parts.select(
        F.col("_part").alias("_p"), *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.row_number().over(earlier).alias("_nth"),
        *(add[name](name).over(before).alias(f"_c{i}") for i, name in enumerate(totals)),
    ).filter("_nth > 1")
    here = placed.select(*rows.columns, "_part", *(total.over(inside).alias(name) for name, total in totals.items()))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))

    def both(name: str, i: int) -> Column:
        own, carry = F.coalesce(name, F.lit(0)), F.coalesce(f"_c{i}", F.lit(0))
        return (own.bitwiseXOR(carry) if add[name] is F.bit_xor else own + carry).alias(name)

    joined = here.join(F.broadcast(carried), same, "left")
    return joined.select(*rows.columns, *(both(name, i) for i, name in enumerate(totals)))
