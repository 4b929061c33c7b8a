"""Reproducible samples: every order comes from a digest of the id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evisift.session import materialize


def digest(column: Column) -> Column:
    return F.sha2(column.cast("string"), 256)


def stratified(rows: DataFrame, strata: list[str], id_col: str, quota: int) -> DataFrame:
    """The first ``quota`` ids of each stratum in md5 order."""
    order = W.partitionBy(*strata).orderBy(F.md5(F.col(id_col)), F.col(id_col))
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= quota)


def sequential_quota(pools: DataFrame, quotas: list[tuple[str, int]], id_col: str) -> DataFrame:
    """Fill strata one after the other from overlapping pools without repeating an id.

    ``pools(stratum, id)``. A stratum can lose at most the ids chosen before it, so only its
    first (own + earlier quotas) ids can ever matter; the loop runs on that bounded remainder.
    """
    bound, reach = [], 0
    for name, quota in quotas:
        reach += quota
        bound.append((name, reach))
    limit = F.create_map(*[F.lit(x) for pair in bound for x in pair])
    order = W.partitionBy("stratum").orderBy(digest(F.col(id_col)), F.col(id_col))
    head = (
        pools.select("stratum", id_col).distinct()
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= reach)  # a literal bound, so every task keeps only the head of its strata
        .filter(F.col("_n") <= F.try_element_at(limit, F.col("stratum")))
    )
    head = materialize(head, "quota-head")
    chosen: list[DataFrame] = []
    for name, quota in quotas:
        pool = head.filter(F.col("stratum") == name)
        if chosen:
            taken = reduce(DataFrame.unionByName, chosen).select(id_col)
            pool = pool.join(taken, id_col, "left_anti")
        picked = pool.orderBy("_n").limit(quota).select("stratum", id_col)
        chosen.append(materialize(picked, "quota-pick"))
    return reduce(DataFrame.unionByName, chosen)


def capped_greedy(
    rows: DataFrame, domains: list[str], *, per_domain: int, per_topic: int, total: int,
) -> DataFrame:
    """Greedy scan in digest order with a cap per domain, per topic and overall.

    ``rows(id, topic, domain)`` has one row per domain of an item. Each pass numbers the
    unused items inside their topic, drops those beyond what the topic has left, and takes the
    first ones overall, which is what scanning them in order would take.
    """
    hashed = rows.withColumn("_h", digest(F.col("id")))
    chosen: DataFrame | None = None

    def one_pass(pool: DataFrame, size: int) -> DataFrame:
        free = F.lit(per_topic)
        if chosen is not None:
            taken = chosen.groupBy("topic").agg(F.count("*").alias("_taken"))
            pool = pool.join(chosen.select("id"), "id", "left_anti").join(taken, "topic", "left")
            free = F.lit(per_topic) - F.coalesce("_taken", F.lit(0))
        order = W.partitionBy("topic").orderBy("_h", "id")
        return (
            pool.withColumn("_n", F.row_number().over(order))
            .filter(F.col("_n") <= per_topic)
            .filter(F.col("_n") <= free)
            .orderBy("_h", "id")
            .limit(size)
            .select("id", "topic")
        )

    for domain in domains:
        picked = one_pass(hashed.filter(F.col("domain") == domain), per_domain).withColumn("pass", F.lit(domain))
        picked = materialize(picked, "greedy-pick")
        chosen = picked if chosen is None else chosen.unionByName(picked)
    everyone = hashed.select("id", "topic", "_h").distinct()
    final = one_pass(everyone, total).withColumn("pass", F.lit("rest"))
    if chosen is None:
        return final
    # no more than ``total`` rows are numbered here
    number = F.row_number().over(W.orderBy(digest(F.col("id")), "id"))
    room = final.withColumn("_r", number).filter(F.col("_r") <= F.lit(total) - chosen.agg(F.count("*").alias("n")).scalar()).drop("_r")
    return chosen.unionByName(room)


def round_robin(rows: DataFrame, strata: list[str], id_col: str, size: int) -> DataFrame:
    """One item per stratum and round, strata in digest order, until ``size`` items."""
    key = digest(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata]))
    order = W.partitionBy(*strata).orderBy(digest(F.col(id_col)), F.col(id_col))
    return (
        rows.withColumn("round", F.row_number().over(order))
        .filter(F.col("round") <= size)
        .withColumn("_key", key)
        .orderBy("round", "_key")
        .limit(size)
        .drop("_key")
    )


def control(rows: DataFrame, strata: list[str], id_col: str, rule: str, size: int) -> DataFrame:
    """Round-robin sample with an equal quota per rule, refilled from what is left."""
    rules = rows.select(rule).distinct()
    n = rules.agg(F.count("*").alias("n")).scalar()
    index = rules.withColumn("_i", F.row_number().over(W.orderBy(rule)) - 1)
    quota = F.floor(F.lit(size) / n) + F.when(F.col("_i") < F.lit(size) % n, 1).otherwise(0)
    key = digest(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata]))
    inner = W.partitionBy(rule, *strata).orderBy(digest(F.col(id_col)), F.col(id_col))
    outer = W.partitionBy(rule).orderBy("_round", "_key")
    picked = (
        rows.withColumn("_round", F.row_number().over(inner))
        .filter(F.col("_round") <= size)
        .withColumn("_key", key)
        .withColumn("_n", F.row_number().over(outer))
        .filter(F.col("_n") <= size)
        .join(index, rule)
        .filter(F.col("_n") <= quota)
        .select(*rows.columns)
    )
    picked = materialize(picked, "control-pick")
    rest = rows.join(picked.select(id_col), id_col, "left_anti")
    refill = round_robin(rest, strata, id_col, size)
    order = W.orderBy("round", digest(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata])))
    room = F.lit(size) - picked.agg(F.count("*").alias("n")).scalar()
    return picked.unionByName(refill.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= room).select(*rows.columns))
