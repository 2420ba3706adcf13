"""Graph operators on edge tables, with a bound on depth that is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import with_checkpoints

DEPTH = 50


def closure(edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """edges: src, dst. (src, dst, hops) of every node reachable by one edge or more, with the least number of hops.

    Each round doubles the length that is known: a shortest path of m + h hops, h <= m, is one of exactly m hops and one of h. Work ends when a round
    finds nothing."""
    edges = with_checkpoints(edges)
    found = edges.select("src", "dst").distinct().withColumn("hops", F.lit(1)).checkpoint()
    known = 1
    while True:
        half = found.filter(F.col("hops") == known).select("src", F.col("dst").alias("via"))
        rest = found.select(F.col("src").alias("via"), "dst", F.col("hops").alias("more"))
        new = half.join(rest, "via").groupBy("src", "dst").agg((F.min("more") + known).cast("int").alias("hops"))
        new = new.join(found.select("src", "dst"), ["src", "dst"], "left_anti").checkpoint()
        if new.isEmpty():
            return found
        if new.filter(F.col("hops") > depth).limit(1).count():
            raise ValueError(f"a path of over {depth} edges")
        found = found.unionByName(new).checkpoint()
        known *= 2


def merge_roots(merges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """merges: node, into (one row a node). (node, root, hops): where each chain of merges ends. Chains double each round."""
    merges = with_checkpoints(merges)
    at = merges.select("node", F.col("into").alias("root"), F.lit(1).alias("hops")).checkpoint()
    for _ in range(depth.bit_length() + 1):
        up = at.select(F.col("node").alias("root"), F.col("root").alias("above"), F.col("hops").alias("more"))
        at = at.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("above").isNotNull().alias("moved")).checkpoint()
        if at.filter("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")
    raise ValueError("a cycle of merges, or a chain that is too long")
