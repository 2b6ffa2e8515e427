"""Connected components by contraction: each round the graph shrinks to the roots of its smallest-neighbour trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _follow(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Replace each ``root`` of (node, root) by its own root where it has one."""
    step = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return pairs.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node that it can reach.

    Every node points to its smallest neighbour if that is smaller; pointers are followed twice, the graph is
    rewritten between roots and repeated edges vanish, so a hub shrinks to one node after a round. A path of n nodes
    takes log4(n) rounds. Loops and repeated edges are allowed; no edges give no rows. Each round writes its shrinking
    edges and the labels to the shared folder, so a lost executor repeats one round at most.
    """
    open_edges = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not open_edges.isEmpty():
        parents = open_edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        parents = cut_lineage(parents)
        parents = cut_lineage(_follow(_follow(parents, parents), parents))
        if labels is None:
            ends = open_edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            labels = ends.withColumn("root", F.col("node"))
        labels = cut_lineage(_follow(labels, parents))
        moved = open_edges
        for end, other in (("a", "b"), ("b", "a")):
            step = parents.select(F.col("node").alias(end), F.col("root").alias("next"))
            moved = moved.join(step, end, "left").select(F.coalesce("next", end).alias(end), other)
        open_edges = cut_lineage(
            moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
    if labels is None:
        labels = open_edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
