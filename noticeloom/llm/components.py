"""Connected components by label propagation with pointer jumping, all in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.session import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every endpoint of ``edges``; component is the smallest node reached.

    Edges are undirected and may repeat, loop or hold nulls (ignored). Every round takes the
    smallest label among the neighbours, then follows labels of labels, so that the number of
    rounds grows with the logarithm of a component's diameter for the trees that duplicate
    detection gives. A node with very many edges is pre-aggregated before its shuffle.
    """
    kept = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = written(kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("offered"))
        )
        stepped = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("was"), F.least("component", "offered").alias("component")
        )
        roots = stepped.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = written(
            stepped.join(roots, "component", "left").select(
                "node", "was", F.least("component", F.coalesce("root", "component")).alias("component")
            )
        )
        labels = after.select("node", "component")
        if after.where(F.col("component") != F.col("was")).isEmpty():
            return labels
