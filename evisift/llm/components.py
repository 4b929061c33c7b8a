"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.session import materialize


def min_labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id`` of every node of an edge and ``label``, the smallest id reachable from it.

    Rounds of neighbour minimum and of following labels, each written out, until nothing changes: their
    number grows with the logarithm of the longest path in all but contrived orders. Neighbour minima are combined
    before the shuffle, so a node with very many edges is no hot group. Loops and repeated edges do no harm; no edges
    give no rows.
    """
    pairs = edges.select(F.col(a).alias("id"), F.col(b).alias("other"))
    pairs = materialize(pairs.union(pairs.select("other", "id")).distinct(), "edges")
    labels = materialize(pairs.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("label")), "labels")
    while True:
        seen = labels.select(F.col("id").alias("other"), F.col("label").alias("near"))
        near = pairs.join(seen, "other").groupBy("id").agg(F.min("near").alias("near"))
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("hop"))
        step = labels.join(near, "id").join(hop, "label", "left")
        step = materialize(step.select("id", F.least("label", "near", "hop").alias("new"), "label"), "labels")
        done = step.filter("new != label").isEmpty()
        labels = step.select("id", F.col("new").alias("label"))
        if done:
            return labels
