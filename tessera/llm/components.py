"""Connected components by alternating large-star and small-star steps.

Edges shrink to stars whose centre is the smallest node of its component. Every step pre-aggregates the smallest
neighbour per node and joins it back; the aggregated side is dealt anew before the join so that a node with very many
edges can be split over tasks. Each round is written to the shared folder. Nothing is collected on the driver but two
sums per round that tell whether the edges changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest v of u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.repartition(F.xxhash64("u")), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node that can be reached."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                 "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        # large star: neighbours above u point to the smallest of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_smallest(both).where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        # small star: u and its neighbours below point to the smallest of those
        small = _with_smallest(large)
        now = stored(small.select("u", F.col("m").alias("v"))
                     .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(),
                     "edges")
