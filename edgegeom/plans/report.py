"""The per-edge report: structure, curvatures, envelopes and transfer bounds in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..columns import GRAPH, REPORT_COLUMNS
from ..functions import bounds as B, params as P
from ..operators.clean import canonical_edges, edgewise, prepare
from ..operators.curvature import curvature_table
from ..operators.stats import summarize_run
from ..operators.transport import HEAVY_DEGREE
from ..sources.reports import read_report_csv, write_report_csv, write_summary
from ..staging import stage


def with_envelopes(table: DataFrame) -> DataFrame:
    """Add the linear and the transport envelope."""
    return table.withColumns({
        "env_const": P.envelope_const("deg_u", "deg_v"),
        "env_slope": P.envelope_slope("deg_u", "deg_v"),
        "env_at_tri": P.linear_envelope("deg_u", "deg_v", "n_tri"),
        "env_transport": P.transport_envelope("deg_u", "deg_v", "n_tri", "n_quad")["upper"],
    })


def bounds_from_forman(table: DataFrame, zeta, sharp: bool = True) -> DataFrame:
    """Interval for the lazy curvature, ``or_lo .. or_hi``, from Balanced Forman values.

    ``zeta`` is a number or a table ``(graph_id, u, v, x)``.
    """
    plain = F.col("or_plain") if sharp else None
    return edgewise(table, zeta, "zeta").withColumns({
        "or_lo": B.lazy_lower_from_forman("zeta", "deg_u", "deg_v", "quad_term", plain),
        "or_hi": B.lazy_upper_from_forman("zeta", "deg_u", "deg_v"),
    })


def bounds_from_lazy(table: DataFrame, theta, sharp: bool = True) -> DataFrame:
    """Interval for Balanced Forman, ``bf_lo .. bf_hi``, from lazy curvature values.

    ``theta`` is a number or a table ``(graph_id, u, v, x)``.
    """
    plain = F.col("or_plain") if sharp else None
    return edgewise(table, theta, "theta").withColumns({
        "bf_lo": B.forman_lower_from_lazy("theta", "deg_u", "deg_v", "n_tri"),
        "bf_hi": B.forman_upper_from_lazy("theta", "deg_u", "deg_v", "quad_term", plain),
    })


def with_own_bounds(table: DataFrame) -> DataFrame:
    """Both transfer intervals at each edge's own curvature values; no join needed."""
    plain = F.col("or_plain")
    return table.withColumns({
        "or_lo": B.lazy_lower_from_forman("bf", "deg_u", "deg_v", "quad_term", plain),
        "or_hi": B.lazy_upper_from_forman("bf", "deg_u", "deg_v"),
        "bf_lo": B.forman_lower_from_lazy("or_lazy", "deg_u", "deg_v", "n_tri"),
        "bf_hi": B.forman_upper_from_lazy("or_lazy", "deg_u", "deg_v", "quad_term", plain),
    })


def report_of(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """Report of a prepared edge table (see ``prepare``)."""
    return with_own_bounds(with_envelopes(curvature_table(degreed, heavy_degree))).select(
        *REPORT_COLUMNS
    )


def edge_report(pairs: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """Report of any table of pairs ``(graph_id, u, v)``: cleaned, then one row per edge."""
    arcs = pairs.select(GRAPH, F.col("u").alias("src"), F.col("v").alias("dst"))
    return report_of(prepare(canonical_edges(arcs)), heavy_degree)


def analyze(pairs: DataFrame, report_path: str, summary_path: str) -> DataFrame:
    """Write the report as CSV and the run summary as JSON; return the written report."""
    spark = pairs.sparkSession
    report = stage(edge_report(pairs), "report")
    write_report_csv(report, report_path)
    write_summary(summarize_run(report), summary_path)
    return read_report_csv(spark, report_path)
