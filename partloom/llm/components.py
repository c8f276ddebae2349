"""Connected components of a distributed edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b): undirected, of any ordered type. Returns node, component (the smallest node reachable) of every node
    that has a smaller one; nodes that are missing are their own component.

    Each round writes its edges to the shared folder, so lineage stays short and lost executors cost one round at most.
    Rounds grow with the logarithm of the longest path. Self-loops and nulls don't count; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = _mark(now)
    while was[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if (mark := _mark(now)) == was:
            break
        was = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    n, x = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return n, x
