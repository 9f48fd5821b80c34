"""Graphs derived from order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import EDGE_KEY, GRAPH
from ..operators.clean import canonical_edges
from ..staging import freed_shuffles, stage


#: Lines of one order that are matched under one key.
CHUNK_LINES = 64


def co_order_edges(
    lineitem: DataFrame,
    graph_id: Column | None = None,
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """Parts bought in one order: all pairs of its lines, or of those with the same ``graph_id``.

    An order of more than ``chunk_lines`` lines is dealt over chunks, and every pair of chunks is
    a key of its own, so no key holds more than two chunks and no pair is lost. Orders are counted as soon as
    this is called, first without their graphs; where none is that large, lines meet by their order alone.
    """
    graph = F.lit("co_order") if graph_id is None else graph_id
    # The number comes first: joins sort by their keys in turn, and names that many rows share tell few of them apart.
    order = ["l_orderkey", GRAPH]
    lines = lineitem.select(
        graph.cast("string").alias(GRAPH), "l_orderkey",
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    large = _large_orders(lines, order, chunk_lines)
    if large is None:
        # Both sides are the same lines, which are shuffled once.
        left, right = (lines.select(*order, F.col("part").alias(end)) for end in ("part_a", "part_b"))
        return _edges_of(left.join(right, order).filter(F.col("part_a") < F.col("part_b")))
    chunks = F.ceil(F.coalesce("size", F.lit(1)) / chunk_lines).cast("int")
    dealt = lines.join(large, order, "left").withColumn(
        "chunk", F.pmod(F.xxhash64("line", "part"), chunks).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select(*order, "part", "chunk", F.least("chunk", "other").alias("low"),
                         F.greatest("chunk", "other").alias("high"))
    left = dealt.filter(F.col("chunk") == F.col("low")).withColumnRenamed("part", "part_a")
    right = dealt.filter(F.col("chunk") == F.col("high")).withColumnRenamed("part", "part_b")
    met = left.drop("chunk").join(right.drop("chunk"), [*order, "low", "high"]).filter(
        (F.col("low") < F.col("high")) | (F.col("part_a") < F.col("part_b")))
    return _edges_of(met)


def _large_orders(lines: DataFrame, order: list[str], chunk_lines: int) -> DataFrame | None:
    """Orders of more than ``chunk_lines`` lines of one graph and their ``size``, staged; nothing if there are none.

    They are looked for only where an order has so many lines in all graphs.
    """
    with freed_shuffles(lines.sparkSession):
        most = lines.groupBy("l_orderkey").agg(F.count("*").alias("size")).agg(F.max("size")).first()[0] or 0
    if most <= chunk_lines:
        return None
    large = stage(lines.groupBy(*order).agg(F.count("*").alias("size")).filter(F.col("size") > chunk_lines), "large-orders")
    return None if large.isEmpty() else large


def _edges_of(met: DataFrame) -> DataFrame:
    return canonical_edges(
        met.select(GRAPH, F.col("part_a").alias("src"), F.col("part_b").alias("dst"))
    ).select(*EDGE_KEY)
