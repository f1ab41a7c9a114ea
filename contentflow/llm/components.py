"""Connected components by smallest labels, on edges that are never brought together in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contentflow.llm.folders import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for each node that has an edge.

    Each round takes the smallest label among the neighbours and then the label of that label, so the rounds follow
    the logarithm of the longest way. Equal nodes and repeated edges change nothing; without edges the result is empty.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near"))
    both = stored(both.union(edges.select(F.col(b), F.col(a))).distinct(), "component-edges")
    labels = both.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("component"))
    labels = stored(labels, "component-labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("near"), F.col("component").alias("seen")), "near")
            .groupBy("node").agg(F.min("seen").alias("seen"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "seen").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = step.join(jump, "component").select("node", "before", F.least("component", "further").alias("component"))
        after = stored(after, "component-labels")
        labels = after.select("node", "component")
        if after.filter("before <> component").isEmpty():
            return labels
