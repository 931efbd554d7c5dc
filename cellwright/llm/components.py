"""Connected components by alternating stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node is linked to, for all nodes on an edge.

    edges: columns ``a`` and ``b`` of one orderable type; loops, repeats and nulls are ignored.
    Each round points the larger neighbours of a node at its smallest one (large star), then the
    smaller ones (small star); the edge count never grows, and rounds grow with the logarithm of the
    longest chain. Smallest neighbours are pre-aggregated before the shuffle and written, so that
    the join with the edges has two plain exchanges, of which Spark splits the skewed partitions.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seal = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m")))
        large = scratch.keep(now.join(low, "b").select("a", F.col("m").alias("b")).distinct())
        low2 = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b")))
        after = scratch.keep(small.distinct())
        found = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now, low, large, low2)
        now = after
        if tuple(found) == seal:
            break
        seal = tuple(found)
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
