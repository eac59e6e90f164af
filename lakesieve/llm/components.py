"""Connected components of a graph held in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.llm.common import discard, keep


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge alone, to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("_up"), F.lit(0).alias("_down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("_up"), F.lit(1).alias("_down")))
    nodes = ends.groupBy("node").agg(F.sum("_up").alias("_up"), F.max("_down").alias("_down"))
    return nodes.where("_up > 1 OR _up + _down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, root for every node of an edge, root being the smallest node that it reaches.

    Each step joins every edge to the smallest neighbour of its end, from two written tables, so a node with very many
    neighbours is a skewed join that Spark splits, not one task's group. The number of steps grows with the logarithm of the
    longest chain.
    """
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # Large star: the larger neighbours of a node go to its smallest neighbour.
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        small = large.join(low, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = keep(nxt.where("u <> v").distinct(), "edges")
        discard(now, least, large, low)
        now = nxt
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
