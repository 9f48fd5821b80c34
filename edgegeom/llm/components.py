"""Connected components by alternating stars: shuffles only, a few rounds, no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame, label: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` but the roots; a root is the least of its nodes.

    Every round links each node's larger neighbours, then its smaller ones, to its least neighbour. The
    least is found by an aggregation with partial sums and joined back, so a node with very many
    neighbours is a skewed join key, which adaptive execution splits, and never a group.
    """
    u, v = F.col("u"), F.col("v")
    edges = stage(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), label)
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        edges = stage(small, label)
        before, mark = mark, _mark(edges)
        if before == mark:
            return edges.select(u.alias("node"), v.alias("root"))
