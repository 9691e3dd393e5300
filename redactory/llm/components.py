"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import discard, spread_join, stored


def connected(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, label: every node of an edge with the smallest node that it reaches.

    Each round, a node and its label's node take the smallest label among the node's
    neighbours, then every label is replaced by its own label, until nothing
    changes. Rounds grow with the logarithm of the longest path. All that a round
    moves is a row per node or edge; minima are taken before the shuffles.
    """
    both = stored(edges.where("a <> b").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    total = labels.count()
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        heard = labels.join(near, "node")
        offers = heard.select("node", F.least("label", "low").alias("label")).unionByName(heard.select(F.col("label").alias("node"), F.least("label", "low").alias("label")))
        lower = stored(offers.groupBy("node").agg(F.min("label").alias("label")))
        sizes = lower.groupBy("label").agg(F.count("*").alias("n"))  # a giant component has one label
        onward = lower.select(F.col("node").alias("label"), F.col("label").alias("next")).join(sizes, "label")
        after = stored(spread_join(lower, onward, ["label"], "n", total).select("node", F.least("label", "next").alias("label")))
        changed = not after.join(labels, ["node", "label"], "left_anti").isEmpty()
        discard(labels, lower)
        labels = after
        if not changed:
            discard(both)
            return labels
