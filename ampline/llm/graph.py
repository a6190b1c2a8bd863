"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, label), label the smallest node reachable, for nodes that have an edge.

    Each round is a table in the shared folder; minima are aggregated before
    they are joined, so a node with very many neighbours is no large row. Rounds
    end when an edge set repeats; their number grows with the logarithm of the
    longest path.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, before = materialise(both, "edges"), None
    while True:
        # large star: larger neighbours of u go to the least of u and its neighbours
        near = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        new = materialise(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")
        mark = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(now)
        now = new
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())
