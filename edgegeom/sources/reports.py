"""Per-edge reports, summaries and run manifests at rest."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..columns import EDGE_KEY, GRAPH, REPORT_COLUMNS
from ..staging import freed_shuffles, stage

STATS = ("STRUCT<count: BIGINT, mean: DOUBLE, std: DOUBLE, min: DOUBLE, q05: DOUBLE, q25: DOUBLE, "
         "median: DOUBLE, q75: DOUBLE, q95: DOUBLE, max: DOUBLE>")
RUNS_SCHEMA = f"tag STRING, name STRING, n BIGINT, m BIGINT, summary MAP<STRING, {STATS}>"
COUNT_COLUMNS = ["u", "v", "deg_u", "deg_v", "n_tri", "n_quad", "quad_cap"]


def file_base(tag: Column) -> Column:
    """Tag as used in file and folder names: dots become underscores."""
    return F.replace(tag, F.lit("."), F.lit("_"))


def whole_number(text: Column) -> Column:
    """A cell as BIGINT: digits exactly, other numbers where they are whole and below 2^53."""
    text = F.regexp_replace(text.cast("string"), r"^\s+|\s+$", "")
    double = text.try_cast("double")
    exact = (F.abs(double) < 2.0**53) & (F.floor(double) == double)
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")), F.when(exact, double.try_cast("bigint")))


def _by_graph(rows: DataFrame) -> DataFrame:
    """Rows dealt by graph, so that a graph's folder gets few files; large graphs get several."""
    return rows.hint("rebalance", GRAPH)


def write_report(report: DataFrame, path: str) -> None:
    """Parquet, one folder per graph, named by its exact id."""
    with freed_shuffles(report.sparkSession):
        _by_graph(report).write.partitionBy(GRAPH).parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Reports written by ``write_report``; a filter on the graph reads its folder only.

    The ids of graphs stay text, also where all of them look like numbers.
    """
    found = spark.read.parquet(path)
    fields = ", ".join(f"`{c}` {t}" for c, t in found.dtypes if c != GRAPH)
    return spark.read.schema(f"{fields}, `{GRAPH}` STRING").parquet(path).select(*found.columns)


def write_report_csv(report: DataFrame, path: str) -> None:
    """CSV with a header line, one folder per graph, for exchange with other tools."""
    with freed_shuffles(report.sparkSession):
        _by_graph(report).write.partitionBy(GRAPH).option("header", True).csv(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header line; all cells and the ids of graphs as text."""
    names = spark.read.option("header", True).csv(path).columns
    fields = ", ".join(f"`{c}` STRING" for c in names)
    return spark.read.schema(fields).option("header", True).csv(path)


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reports from CSV: column names in any case, cells that are no number become null."""
    raw = read_csv_text(spark, path)
    known = {c.lower(): c for c in REPORT_COLUMNS}
    named = raw.withColumnsRenamed({c: known[c.lower()] for c in raw.columns if c.lower() in known})
    typed = []
    for c in named.columns:
        if c == GRAPH or c not in REPORT_COLUMNS:
            typed.append(F.col(c).cast("string").alias(c))
        else:
            number = F.trim(F.col(c).cast("string")).try_cast("double")
            typed.append(whole_number(F.col(c)).alias(c) if c in COUNT_COLUMNS else number.alias(c))
    return named.select(*typed)


#: Rows that one bucket of a report table is meant for.
ROWS_PER_BUCKET = 4_000_000


def save_report_table(rows: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Rows with an edge key as table ``name`` at ``path``, in sorted buckets of the whole edge key.

    Tables of the same number of buckets join, and group by the edge key, without a shuffle. The key is
    the edge and not the graph, so a graph that holds most edges lies in all buckets alike. Take
    ``rows.count() / ROWS_PER_BUCKET`` buckets, and the same for all tables of a run.
    """
    dealt = rows.repartition(buckets, *EDGE_KEY)
    with freed_shuffles(rows.sparkSession):
        dealt.write.bucketBy(buckets, *EDGE_KEY).sortBy(*EDGE_KEY).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


@contextmanager
def footer_reads(spark: SparkSession) -> Iterator[None]:
    """While it holds, counts and extremes of Parquet columns are planned as reads of file footers."""
    wanted = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, x in wanted.items():
        spark.conf.set(k, x)
    try:
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def footer_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(graph_id, n, m)`` of reports in Parquet; to be planned and run within ``footer_reads``.

    An edge's second node is its larger one, so the largest id is a column's maximum and no row is read.
    Footers are looked up by a column's place, so the schema has all columns as they are in the files.
    """
    return read_report(spark, path).groupBy(GRAPH).agg((F.max("v") + 1).alias("n"), F.count("*").alias("m"))


def stored_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(graph_id, n, m)`` of reports written by ``write_report``, from their footers."""
    with footer_reads(spark):
        return stage(footer_sizes(spark, path), "sizes")


def report_for_tag(reports: DataFrame, tag: str) -> DataFrame:
    """Rows of one tag; without it, of the first graph whose name starts as its file would.

    Files of other tools have underscores for the dots of a tag.
    """
    base = tag.replace(".", "_")
    found = reports.filter((F.col(GRAPH) == tag) | F.col(GRAPH).startswith(base))
    first = (
        found.select(GRAPH).distinct()
        .orderBy(F.col(GRAPH) != tag, F.col(GRAPH) != base, GRAPH).limit(1)
    )
    return found.join(first, GRAPH, "left_semi")


def graph_sizes(rows: DataFrame) -> DataFrame:
    """``(graph_id, n, m)`` from a table with u and v, which may still be text.

    Rows without two numbers are not counted.
    """
    u, v = (whole_number(F.col(c)) for c in ("u", "v"))
    return (
        rows.select(GRAPH, u.alias("u"), v.alias("v"))
        .filter(F.col("u").isNotNull() & F.col("v").isNotNull())
        .groupBy(GRAPH)
        .agg((F.max(F.greatest("u", "v")) + 1).alias("n"), F.count("*").alias("m"))
    )


def stray_reports(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Sizes of the graphs on disk that no run mentions, by their exact tags."""
    mentioned = runs.select(F.col("tag").alias(GRAPH))
    return graph_sizes(reports.join(mentioned, GRAPH, "left_anti"))


def summary_json(summary: DataFrame) -> DataFrame:
    """One JSON document per graph in column ``value``."""
    rest = [c for c in summary.columns if c != GRAPH]
    return summary.select(GRAPH, F.to_json(F.struct(*rest)).alias("value"))


def write_summary(summary: DataFrame, path: str) -> None:
    """JSON documents as text, one folder per graph."""
    _by_graph(summary_json(summary)).write.partitionBy(GRAPH).text(path)


def write_manifest(runs: DataFrame, path: str) -> None:
    """One JSON line per run."""
    runs.write.json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Runs from JSON lines, or from one document ``{"runs": [...]}``.

    The tag falls back to the name and then to ``run``.
    """
    wrapped = spark.read.schema(f"runs ARRAY<STRUCT<{RUNS_SCHEMA}>>, {RUNS_SCHEMA}").option(
        "multiLine", False).json(path)
    lines = wrapped.filter(F.col("runs").isNull()).select("tag", "name", "n", "m", "summary")
    inner = wrapped.filter(F.col("runs").isNotNull()).select(F.inline("runs")).select(
        "tag", "name", "n", "m", "summary")
    return _named(lines.unionByName(inner))


def read_manifest_document(spark: SparkSession, path: str) -> DataFrame:
    """Runs of manifest documents that span several lines, one document per file."""
    documents = spark.read.schema(f"runs ARRAY<STRUCT<{RUNS_SCHEMA}>>").option(
        "multiLine", True).json(path)
    return _named(documents.select(F.inline("runs")))


def _named(runs: DataFrame) -> DataFrame:
    return runs.select(
        F.coalesce("tag", "name", F.lit("run")).alias("tag"), "n", "m", "summary"
    )
