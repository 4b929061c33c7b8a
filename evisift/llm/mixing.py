"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected number of copies is its whole part, taken for certain,
and a rest, its inclusion probability. For the rest, documents are ranked by random odds divided by inclusion
odds and taken from the lowest on until a fixed number of words is reached. Ranking is within strata of a source
and a power of two of the size, so a few very long texts can't make or miss a target on their own; the words
that are missing at the ends of the strata are made up by the next documents in rank.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.llm.ordered import running
from evisift.session import materialize

BLANKS = r"[\x20\x09-\x0D]+"
# Inclusion probabilities are whole multiples of 1 / UNIT, so that their sums don't depend on the order.
UNIT = 1 << 30
# Next documents of each stratum that may make up what its source still lacks.
NEXT = 6


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANKS))).cast("long")


def _sum(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(38,0)"))


def fill_levels(rows: DataFrame, group: list[str], room: str, weight: str, amount: str, limit: float, label: str) -> DataFrame:
    """Per group the level at which ``min(limit * room, level * weight)`` sums to ``amount``: group and ``level``.

    Rows that reach their limit share out no more than that, and the others share the excess by weight. ``room`` and
    ``weight`` are whole numbers of at least 0; ``amount`` is the same all over a group. Where even all limits
    don't reach the amount, the level is above every row's limit.
    """
    counted = rows.filter(f"{weight} > 0").withColumn("_ratio", F.col(room) / F.col(weight))
    totals = {"_room": _sum(room), "_weight": _sum(weight)}
    placed = running(counted, group, [F.col("_ratio"), F.col(weight)], totals, label)
    whole = counted.groupBy(*group).agg(_sum(weight).alias("_all"))
    if group:
        renamed = whole.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(group)), "_all")
        same = F.lit(True)
        for i, c in enumerate(group):
            same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
        placed = placed.join(renamed, same)
    else:
        total = whole.first()["_all"]
        placed = placed.withColumn("_all", F.lit(total))
    left = (F.col(amount) - limit * F.col("_room").cast("double")) / (F.col("_all") - F.col("_weight")).cast("double")
    # the level rises over the rows that reach their limit and falls behind the first that doesn't
    return placed.groupBy(*group).agg(F.max(left).alias("level"))


def source_targets(sizes: DataFrame, *, weights: Iterable[int] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``source``, ``source_size`` and its ``target``: ``share`` of all words, by weight.

    Sources take ``weights`` in turn, by code point, null last. No target is above ``limit`` times its source's size;
    the excess goes to the others by weight.
    """
    weights = list(weights)
    sources = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    placed = running(sources, [], [F.col("source").isNull(), F.col("source")], {"nth": F.count(F.lit(1))}, "sources_placed")
    total = F.lit(share * (sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0))
    turn = F.get(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights)).cast("int")).cast("long")
    placed = materialize(placed.select("source", "source_size", turn.alias("weight"), total.alias("amount")), "sources_weighed")
    found = fill_levels(placed, [], "source_size", "weight", "amount", limit, "sources_filled").first()
    level = F.lit(found["level"] if found else None).cast("double")
    return placed.select("source", "source_size", F.least(limit * F.col("source_size"), level * F.col("weight")).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number above 0 and below 1 that depends on the key and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), key), 12).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _greedy(sizes: list[int], lack: float, first: int | None) -> tuple[list[int], float]:
    """Places taken from sizes in descending order, ``first`` before all others, and what is then missing."""
    taken = [] if first is None else [first]
    lack -= 0 if first is None else sizes[first]
    for at, size in enumerate(sizes):
        if at != first and size <= lack:
            taken.append(at)
            lack -= size
    return taken, lack


def _make_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a source's documents around the ends of its strata those that bring it nearest to its target.

    The drawn ones stay where the others then make up all but a thousandth of the target; if not, they are open too.
    """
    rows = rows.sort_values(["size", "rank", "stratum"], ascending=[False, True, True])
    lack, near, best = float(rows["lack"].iloc[0]), float(rows["near"].iloc[0]), None
    for kept in (rows["drawn"], rows["drawn"] & False):
        if best is not None and best[0] <= near:
            break
        free = rows.index[~kept]
        sizes = rows.loc[free, "size"].astype(int).tolist()
        for first in (None, *range(len(sizes))):
            taken, missing = _greedy(sizes, lack - float(rows.loc[kept, "size"].sum()), first)
            if best is None or abs(missing) < best[0]:
                best = abs(missing), [*rows.index[kept], *free[taken]]
            if best[0] <= near:
                break
    return rows[["source", "stratum", "rank"]].assign(extra=rows.index.isin(best[1]))


def mix_sources(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, weights: Iterable[int] = (3, 1, 2),
    share: float = 1.5, limit: float = 2.0, seed: int = 0, keep: Iterable[str] = (),
) -> DataFrame:
    """Every row with the copies of it that the mix takes.

    Columns: ``doc_id``, ``size`` in words, ``source_size``, ``target`` in words of its source, ``copies``, ``taken`` =
    copies * size, and the columns ``keep`` of ``docs`` (the text, say). ``weight`` names a column of relative weights
    for the documents of a source; without it all have the same. Null, negative and NaN weights are 0: never taken;
    they are counted in millionths, up to 10**12.

    Null or blank texts have size 0 and are never taken. Null sources are one source. The same rows give the same mix:
    random numbers come from id and seed; rows that tie in id, size and weight may stand for each other. No document
    has more than ``limit`` copies, rounded up. No rows give no rows.
    """
    keep = list(keep)
    relative = F.lit(1.0) if weight is None else F.when(F.col(weight).cast("double") > 0, F.nanvl(F.col(weight).cast("double"), F.lit(0.0))).otherwise(0.0)
    rows = docs.select(
        F.struct(*(docs[c] for c in keep)).alias("kept") if keep else F.lit(None).alias("kept"),
        F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"),
        F.round(F.least(relative, F.lit(1e12)) * 1_000_000).cast("decimal(19,0)").alias("relative"),
    )
    if not keep:
        rows = rows.drop("kept")
    rows = materialize(rows, "sizes")
    targets = materialize(source_targets(rows, weights=weights, share=share, limit=limit).withColumnRenamed("source", "_source"), "targets")
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    if weight is None:
        expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    else:
        shares = joined.withColumn("part", F.col("relative") * F.col("size").cast("decimal(18,0)")).select("source", "size", "part", "target")
        levels = fill_levels(materialize(shares, "shares"), ["source"], "size", "part", "target", limit, "weighed")
        levels = materialize(levels.withColumnRenamed("source", "_source"), "levels")
        joined = joined.join(levels, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        expected = F.coalesce(F.least(F.lit(float(limit)), F.col("level") * F.col("relative")), F.lit(0.0))
    units = F.when(F.col("size") > 0, F.round(expected * UNIT)).otherwise(0).cast("long")
    joined = joined.withColumn("units", units).withColumns({"whole": F.floor(F.col("units") / UNIT), "units": F.col("units") % UNIT})

    odds = F.col("units") / (UNIT - F.col("units"))
    u = uniform(F.col("doc_id"), seed)
    ranked = joined.withColumns(
        {"stratum": F.length(F.bin("size")), "order": F.when(F.col("units") > 0, u / (1 - u) / odds), "due": (F.col("units") * F.col("size").cast("decimal(38,0)"))}
    )
    order = [F.col("order").asc_nulls_last(), F.col("doc_id"), F.col("size"), F.col("units")]
    totals = {"rank": F.count(F.lit(1)), "words": F.sum("size")}
    ranked = materialize(running(ranked, ["source", "stratum"], order, totals, "ranked"), "ranked")

    strata = ranked.groupBy("source", "stratum").agg(F.floor(F.sum("due") / UNIT).cast("long").alias("budget"))
    strata = materialize(strata.select(F.col("source").alias("_source"), F.col("stratum").alias("_stratum"), "budget"), "strata")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("stratum") == F.col("_stratum"))
    drawn = ranked.join(strata, same).drop("_source", "_stratum")
    drawn = drawn.withColumn("drawn", (F.col("units") > 0) & (F.col("words") + F.col("size") <= F.col("budget")))
    drawn = materialize(drawn, "drawn")

    # the documents next to the ends of the strata are left open
    into, beyond = (Window.partitionBy("source", "stratum").orderBy(by) for by in (F.col("rank").desc(), F.col("rank")))
    place = ["source", "stratum", "rank", "size", "drawn"]
    pool = drawn.filter("drawn").select(*place, F.row_number().over(into).alias("nth")).filter(F.col("nth") <= NEXT)
    pool = pool.unionByName(drawn.filter("units > 0 and not drawn").select(*place, F.row_number().over(beyond).alias("nth")).filter(F.col("nth") <= NEXT))
    pool = materialize(pool.drop("nth"), "pool")
    open_words = pool.filter("drawn").groupBy("source").agg(F.sum("size").alias("open")).withColumnRenamed("source", "_source")
    wanted = F.sum("due").cast("double") / UNIT if weight is not None else F.max("target") - F.sum(F.col("whole") * F.col("size"))
    lack = drawn.groupBy("source").agg(
        (wanted - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("lack"), (F.max("target") / 1000).alias("near")
    )
    lack = lack.join(open_words, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        F.col("source").alias("_source"), (F.col("lack") + F.coalesce("open", F.lit(0))).alias("lack"), "near"
    )
    opened = pool.join(lack, F.col("source").eqNullSafe(F.col("_source"))).select(*place, "lack", "near").groupBy("source")
    decided = materialize(opened.applyInPandas(_make_up, "source string, stratum int, rank long, extra boolean"), "decided")
    decided = decided.select(F.col("source").alias("_source"), F.col("stratum").alias("_stratum"), F.col("rank").alias("_rank"), "extra")
    mixed = drawn.join(decided, same & (F.col("rank") == F.col("_rank")), "left")
    copies = F.col("whole") + F.coalesce("extra", "drawn").cast("long")
    return mixed.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *(F.col(f"kept.{c}").alias(c) for c in keep),
    )


def mixed_texts(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix_sources`` as often as it is taken, with ``copy`` from 1."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
