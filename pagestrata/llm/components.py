"""Connected components of an edge table, by alternating stars.

Each round replaces the edges of a node by edges to the smallest node it knows
(first over larger, then over smaller neighbours), which keeps connectivity and
ends in one star per component after a logarithmic number of rounds. Minima are
aggregated before the shuffle. A hub's edges then meet its minimum in a join on
the node, as a stream of pairs of integers, never as a list; adaptive execution
splits such a join where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the smallest node.

    Self-loops and repeated edges are allowed, nulls are not; no edges give no rows.
    """
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while not _are_stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(
            small.union(least.select("a", "m"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct(),
            "small-star",
        )
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up, or none and is a root (edges: a > b, distinct)."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    seen = ends.groupBy("v").agg(F.sum("up").alias("ups"), F.min("up").alias("leaf"))
    return seen.where("ups > 1 or (ups = 1 and leaf = 0)").isEmpty()
