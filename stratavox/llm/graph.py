"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long, a <> b) but the roots; root is the least node reachable.

    Alternating large-star and small-star rounds, each stored in the shared folder; the number of rounds grows with the
    logarithm of the longest path. Nodes with a third of all edges are pre-aggregated, and adaptive joins split them.
    """
    now = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).head()
        if sign[0] == 0 or sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
        now = stored(_small_star(_large_star(now)))
