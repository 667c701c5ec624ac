"""Connected components by alternating large-star and small-star steps; every step is joins and grouped minima.

Edges shrink towards stars around each component's smallest node, in a number of rounds that grows with the
logarithm of the graph. Each round is a staged table, so nothing is recomputed and nothing passes the driver but two
numbers that tell whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stage


def _star(pointed: DataFrame, keep_all: bool) -> DataFrame:
    """pointed: (u, v) with u's neighbours v. Each neighbour gets the smallest node around u."""
    least = pointed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    both = pointed.join(least, "u")
    moved = both.filter(F.col("v") != F.col("m")) if keep_all else both.filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))) if keep_all else out


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of longs. Returns (node, component) for every node of an edge, component its smallest node."""
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        before = None
        while True:
            state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before or state[0] == 0:
                return stage(
                    now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
                    )
                )
            before = state
            ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _star(ways, keep_all=False)
            down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
            now = scratch.stage(_star(scratch.stage(down), keep_all=True).distinct())
