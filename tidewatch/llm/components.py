"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest of an edge set."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    onward = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(onward).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v), root being the component's smallest node.

    Nodes are compared as signed longs and hold no null. Hubs are reduced by partial minima before any shuffle; the
    joins on a hub's key are plain sort-merge joins, which adaptive execution splits. Each round is cut, and the number
    of rounds grows with the logarithm of the longest chain.
    """
    edges = cut(
        links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges"
    )
    mark = _mark(edges)
    while mark[0]:
        edges = cut(_small_star(_large_star(edges)), "stars")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
