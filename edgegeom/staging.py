"""Intermediate tables written to the cluster's shared folder.

A table that several branches of a plan read is written once as Parquet. The written copy cuts
the lineage, survives the loss of executors and gives the optimizer real sizes, so it can tell
which sides are small enough to broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[str] = []
#: Shuffle files of a query are deleted when it has run, not when the driver next collects its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a fresh local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="edgegeom-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def staging_path(spark: SparkSession, label: str) -> str:
    """A path below the staging folder, or the open scratch folder, that nothing else uses."""
    return f"{_SCRATCH[-1] if _SCRATCH else staging_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all that is staged while it is open, deleted at its end.

    What is computed within must be written, or counted, before it closes: a table that is read later
    would look for its staged parts.
    """
    path = f"{staging_root(spark)}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    try:
        yield path
    finally:
        _SCRATCH.remove(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run while it is open leave no shuffle files behind.

    A query that is made here and read again later would have to shuffle again.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back; its shuffles are freed."""
    return stage_at(df, staging_path(df.sparkSession, label))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a given path, which may lie outside the open scratch folder."""
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
