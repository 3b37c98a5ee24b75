"""Connected components of a link table, without ever holding a neighbourhood in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node reachable) of every node of links; a link of a node to itself is allowed.

    Alternating large-star and small-star steps by minimum aggregates, each round in a checkpoint, until a round
    changes no link. The rounds grow with the logarithm of the longest chain.
    """
    edges = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: the larger neighbours of a node go to the least of its neighbourhood
        large = edges.select(F.col("u").alias("w"), F.col("v").alias("u")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).union(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small star: a node and its smaller neighbours go to the least of those
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = settle(small)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
