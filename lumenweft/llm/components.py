"""Connected components by alternating large and small stars (Kiveris et al. 2014).

Edges live in tables only.  A star step needs the least neighbour of every
node, an aggregate that combines before its shuffle, and a join that adaptive
execution may split where one node has very many edges.  Each round is written
to the shared folder and the one before is deleted; O(log^2 n) rounds suffice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour to the least of a node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the least of them; u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node that it reaches) for each node with an edge to another."""
    u, v = F.col(a), F.col(b)
    now = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now = stored(now)
    seen = _fingerprint(now)
    while seen[0]:
        before, now = now, stored(_small_star(_large_star(now)))
        dropped(before)
        after = _fingerprint(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
