"""Results of many graphs kept on shared storage, each under a digest of its graph.

Rows are written first and a marker for each graph last, so a marker stands for a whole result. What
has no marker, because a run ended between two graphs or in the middle of one, is done again. A graph
whose digest differs from its marker's is done again as well, any other is read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..columns import EDGE_KEY, GRAPH
from ..operators.clean import canonical_edges
from ..staging import stage

MARKERS = f"{GRAPH} STRING, digest STRING, run STRING, n BIGINT, m BIGINT"


def graph_digests(edges: DataFrame) -> DataFrame:
    """``(graph_id, digest, n, m)`` of clean edges; the digest does not depend on their order."""
    first, second = F.xxhash64("u", "v"), F.xxhash64("v", F.lit("second"), "u")
    m = F.count("*")
    return edges.groupBy(GRAPH).agg(
        F.concat_ws("-", m.cast("string"), F.hex(F.bit_xor(first)), F.hex(F.bit_xor(second)), F.sum(first.cast("decimal(20,0)")).cast("string")).alias("digest"),
        (F.max("v") + 1).alias("n"), m.alias("m"),
    )


class GraphStore:
    """Tables of one kind of result below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.rows_path, self.markers_path = spark, f"{path}/rows", f"{path}/markers"

    def markers(self) -> DataFrame:
        """The last marker of every graph."""
        try:
            found = self.spark.read.schema(MARKERS).parquet(self.markers_path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], MARKERS)
        last = F.row_number().over(Window.partitionBy(GRAPH).orderBy(F.desc("run")))
        return found.withColumn("at", last).filter("at = 1").drop("at")

    def rows(self, graphs: DataFrame | None = None) -> DataFrame:
        """Rows of all graphs with a marker, or of those in ``graphs``."""
        marked = self.markers()
        if graphs is not None:
            marked = marked.join(graphs.select(GRAPH).distinct(), GRAPH, "left_semi")
        found = self.spark.read.parquet(self.rows_path)
        fields = ", ".join(f"`{c}` {t}" for c, t in found.dtypes if c not in (GRAPH, "run"))
        typed = self.spark.read.schema(f"{fields}, run STRING, {GRAPH} STRING").parquet(self.rows_path)
        return typed.join(marked.select("run", GRAPH), ["run", GRAPH], "left_semi").select(GRAPH, *[c for c in found.columns if c not in (GRAPH, "run")])

    def publish(self, result: DataFrame, done: DataFrame) -> None:
        """Write the rows of some graphs, then the markers ``(graph_id, digest, n, m)`` of these graphs."""
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        result.hint("rebalance", GRAPH).write.partitionBy(GRAPH).parquet(f"{self.rows_path}/run={run}")
        done.select(GRAPH, "digest", F.lit(run).alias("run"), "n", "m").write.mode("append").parquet(self.markers_path)

    def pending(self, digests: DataFrame) -> DataFrame:
        """The digests without an equal marker."""
        return digests.join(self.markers().select(GRAPH, "digest"), [GRAPH, "digest"], "left_anti")

    def refresh(self, pairs: DataFrame, compute: Callable[[DataFrame], DataFrame], force: bool = False, parts: int = 1) -> DataFrame:
        """Rows ``(graph_id, ..)`` of ``compute(edges)`` for every graph of ``pairs(graph_id, u, v)``.

        Only graphs without a result of their digest are computed, or all with ``force``. They are
        published in ``parts`` parts, each of them one job, so that an interrupted run keeps what it has
        finished. Nothing is computed, and ``compute`` is not called, for a part without such a graph.
        """
        edges = stage(canonical_edges(pairs.select(GRAPH, F.col("u").alias("src"), F.col("v").alias("dst"))), "edges")
        digests = stage(graph_digests(edges), "digests")
        if digests.isEmpty():
            return compute(edges)
        wanted = digests if force else stage(self.pending(digests), "pending")
        for part in range(parts):
            own = wanted.filter(F.pmod(F.xxhash64(GRAPH), F.lit(parts)) == part)
            if not own.isEmpty():
                self.publish(compute(edges.join(own, GRAPH, "left_semi").select(*EDGE_KEY)), own)
        return self.rows(digests)
