"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): root is the smallest node it reaches.

    Each step hangs neighbours on the smallest one; edges stay as many as nodes and links, no
    neighbour list is built. Each step's minima are aggregated before they are joined and written
    to the shared folder, so both sides of the join have an exchange of their own, and Spark
    splits a hub's rows over tasks. A step's tables go when the next one is written. Loops and
    nulls are ignored, repeated edges count once, no edges give no rows.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    while not _flat(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        large = materialize(large.distinct(), "large")
        small = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        hung = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialize(hung.select("e.u", "e.v").filter("u > v").distinct(), "edges")
        discard(edges, low, large, small)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _flat(edges: DataFrame) -> bool:
    """Whether each node hangs on one other, which hangs on none."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
    roots = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u", "left_semi")
    return twice.unionByName(roots).isEmpty()
