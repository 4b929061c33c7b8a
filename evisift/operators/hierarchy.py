"""Is-a hierarchy operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evisift.session import materialize



def proper_closure(edges: DataFrame) -> DataFrame:
    """``(node, ancestor)`` pairs over one edge or more; a node on a cycle is its own ancestor.

    A round joins the pairs found last with all pairs known, which doubles the length of the paths covered, and
    drops pairs already known, so shared ancestors are not re-expanded per path. Rounds are written out,
    which keeps the plan short and lets a lost executor resume from files. It ends when a round finds nothing.
    """
    known = delta = materialize(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "closure")
    while True:
        ahead = known.select(F.col("node").alias("via"), F.col("ancestor").alias("further"))
        step = (
            delta.join(ahead, delta.ancestor == ahead.via)
            .select("node", F.col("further").alias("ancestor"))
            .distinct()
            .join(known, ["node", "ancestor"], "left_anti")
        )
        delta = materialize(step, "closure-delta")
        if delta.isEmpty():
            return known
        known = known.unionByName(delta)


def ancestor_closure(edges: DataFrame) -> DataFrame:
    """Reflexive ``(node, ancestor)`` pairs of a multi-parent DAG of any depth; a cycle is an error."""
    known = proper_closure(edges)
    if not known.filter(F.col("node") == F.col("ancestor")).isEmpty():
        raise ValueError("the hierarchy has a cycle")
    nodes = edges.select("child").union(edges.select("parent")).distinct()
    return known.unionByName(nodes.select(F.col("child").alias("node"), F.col("child").alias("ancestor")))


def descendants(closure: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs ``(root, node)`` for every node at or below one of the roots."""
    return closure.join(roots.select(F.col("root").alias("ancestor")), "ancestor").select(
        F.col("ancestor").alias("root"), "node"
    )


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that lie on or below a cycle: those that have a node on a cycle among their ancestors."""
    known = proper_closure(edges)
    on_cycle = known.filter(F.col("node") == F.col("ancestor")).select("ancestor")
    return known.join(on_cycle, "ancestor", "left_semi").select("node").distinct()


def propagate(assertions: DataFrame, closure: DataFrame) -> DataFrame:
    """Distinct ``(subject, node)`` where the subject has a positive finding at or below the node.

    A finding's ancestors go to its subjects as one row and are told apart there.
    """
    positive = assertions.filter(F.col("polarity") == "present").select("subject", "finding").distinct()
    above = closure.groupBy("node").agg(F.array_sort(F.collect_list("ancestor")).alias("above"))
    held = positive.join(above, positive.finding == above.node).select("subject", "above").repartition("subject")
    return held.select("subject", F.explode("above").alias("node")).distinct()


def information_content(propagated: DataFrame, positive_subjects: DataFrame) -> DataFrame:
    """``ic = -ln(subjects at or below the node / subjects with any positive finding)``."""
    total = positive_subjects.agg(F.count_distinct("subject").alias("corpus"))
    counts = propagated.groupBy("node").agg(F.count("subject").alias("subjects"))
    # the total is a single row
    return counts.crossJoin(F.broadcast(total)).select(
        "node",
        "subjects",
        (-F.log(F.col("subjects") / F.col("corpus")) + F.lit(0.0)).alias("ic"),
    )


def resnik(pairs: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """Similarity of ``(left, right)`` pairs by their most informative common ancestor.

    Ties go to the smallest code; pairs without a common ancestor score 0 and match nothing.
    """
    distinct = pairs.select("left", "right").distinct()
    up_left = closure.select(F.col("node").alias("left"), "ancestor")
    up_right = closure.select(F.col("node").alias("right"), "ancestor")
    common = distinct.join(up_left, "left").join(up_right, ["right", "ancestor"])
    scored = common.join(ic.select(F.col("node").alias("ancestor"), "ic"), "ancestor", "left")
    best = scored.groupBy("left", "right").agg(
        F.min(F.struct((-F.coalesce("ic", F.lit(0.0))).alias("neg"), "ancestor")).alias("best")
    )
    return distinct.join(best, ["left", "right"], "left").select(
        "left",
        "right",
        F.coalesce(-F.col("best.neg"), F.lit(0.0)).alias("similarity"),
        F.coalesce(F.col("best.ancestor"), F.lit("")).alias("match"),
    )


def domain_assignment(
    closure: DataFrame, domain_roots: DataFrame, mappings: DataFrame | None = None
) -> DataFrame:
    """``(concept_id, domain)`` below each domain root, extended through exact mappings.

    ``domain_roots`` has ``root, domain``; ``mappings`` has ``source_concept_id, target_concept_id``
    of resolved exact crosswalks.
    """
    direct = closure.join(
        domain_roots.select(F.col("root").alias("ancestor"), "domain"), "ancestor"
    ).select(F.col("node").alias("concept_id"), "domain")
    if mappings is None:
        return direct.distinct()
    linked = mappings.join(direct, mappings.source_concept_id == direct.concept_id).select(
        F.col("target_concept_id").alias("concept_id"), "domain"
    )
    return direct.unionByName(linked).distinct()


def structural_markers(
    closure: DataFrame, roots: DataFrame, concepts: DataFrame, prefix: str, mapped: DataFrame
) -> DataFrame:
    """Concepts marked by position, by code prefix or by an exact mapping into a marked system."""
    below = descendants(closure, roots).select(F.col("node").alias("concept_id"))
    coded = concepts.filter(F.col("primary_code").startswith(prefix)).select("concept_id")
    return below.union(coded).union(mapped.select("concept_id")).distinct()


def tree_number_parents(numbers: DataFrame) -> DataFrame:
    """Parent edges from tree numbers: the parent's number is the child's minus its last segment."""
    child = numbers.select(F.col("concept_id").alias("child"), "tree_number").withColumn(
        "parent_number",
        F.regexp_extract("tree_number", r"^(.*)\.[^.]+$", 1),
    )
    parent = numbers.select(
        F.col("concept_id").alias("parent"), F.col("tree_number").alias("parent_number")
    )
    return (
        child.filter(F.col("parent_number") != "")
        .join(parent, "parent_number")
        .filter(F.col("child") != F.col("parent"))
        .select("child", "parent")
        .distinct()
    )


def best_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """First row per key under an explicit order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
