"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them (edges have a > b)."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    linked = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b")
    return linked.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is the component's smallest node.

    Each round is two group-bys and two joins whose aggregated side has one row per node; its result is
    written, so lineage stays short. The number of rounds grows with the logarithm of the longest path.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialise(edges, "cc"), None
    while True:
        n, check = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if (n, check) == before:
            break
        before = (n, check)
        if not n:
            break
        edges = materialise(_small_star(_large_star(edges)), "cc")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
