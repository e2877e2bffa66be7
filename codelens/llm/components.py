"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest node of its neighbourhood."""
    both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
    return both.join(least, "node").where("other > node").select(F.col("other").alias("hi"), F.col("root").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("root"))
    moved = edges.join(least, "hi")
    return moved.select("hi", F.col("root").alias("lo")).union(moved.where("lo > root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node on an edge; component is the smallest node that it reaches.

    Nodes are of any type that has an order, such as longs or strings. Self
    loops, repeated edges and edges with a null end add nothing; without
    edges the result is empty. Each round is written to the shared folder,
    and the one before it deleted. The number of rounds grows with the
    logarithm of the longest path, and no node's neighbours ever meet in one
    row.
    """
    pairs = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct()
    pairs = materialise(pairs, "edges")
    state = None
    while True:
        seen = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if not seen[0] or tuple(seen) == state:
            break
        state = tuple(seen)
        old, pairs = pairs, materialise(_small_star(_large_star(pairs)), "edges")
        discard(old)
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
