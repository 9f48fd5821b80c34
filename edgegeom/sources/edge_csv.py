"""Edge lists kept as headerless CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..columns import EDGE_KEY, GRAPH
from ..operators.clean import canonical_edges

_INTEGER = r"^[+-]?[0-9]+$"


def _node_id(cell: str) -> Column:
    text = F.regexp_replace(cell, r"^\s+|\s+$", "")
    return F.when(text.rlike(_INTEGER), text.try_cast("bigint"))


def read_edge_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Edges of one or many CSV files; ``graph_id`` is the file name without its ending.

    Blank rows, rows that start with ``#`` after trimming, rows with fewer than two cells and rows
    without two integers are skipped, further cells are ignored. Loops and repeats are dropped.
    """
    cells = spark.read.schema("c0 STRING, c1 STRING").csv(paths)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    arcs = (
        cells.select(F.url_decode(name).alias(GRAPH), "c0", "c1")
        .filter(~F.col("c0").rlike(r"^\s*#"))
        .select(GRAPH, _node_id("c0").alias("src"), _node_id("c1").alias("dst"))
        .filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    )
    return canonical_edges(arcs).select(*EDGE_KEY)


def read_edge_folder(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """The named graphs of a folder; names without a file are skipped."""
    return read_edge_csv(spark, f"{folder}/*.csv").filter(F.col(GRAPH).isin(names))
