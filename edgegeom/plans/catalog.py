"""Registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..columns import EDGE_KEY, GRAPH
from ..functions import bounds as B, params as P
from ..operators import builders as G, clean as N, local as L, problems as W, ranks, stats as Q
from ..operators import transport
from ..operators.curvature import curvature_table, forman_table
from ..sources import reports as S
from ..sources.co_order import co_order_edges
from ..sources.edge_csv import read_edge_csv
from ..sources.edge_list import load_edges
from ..staging import stage, staging_path
from . import report as A, suite as R
from .changes import update_report
from .store import GraphStore

SEED = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought together: one graph of all order lines."""
    return co_order_edges(table(spark, sf_dir, "lineitem"))


def by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought together with the same return flag, one graph per flag."""
    return co_order_edges(
        table(spark, sf_dir, "lineitem"), graph_id=F.concat(F.lit("flag_"), F.col("l_returnflag"))
    )


def by_lot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought together in like quantities, one graph per return flag and ten pieces."""
    return _lots(table(spark, sf_dir, "lineitem"))


def _lots(lines: DataFrame) -> DataFrame:
    lot = F.ceil(F.col("l_quantity") / 10).cast("string")
    return co_order_edges(lines, graph_id=F.concat(F.lit("flag_"), F.col("l_returnflag"), F.lit("_"), lot))


def prepared_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.prepare(co_order(spark, sf_dir))


def prepared_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.prepare(by_flag(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.prepare(by_lot(spark, sf_dir))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles cut to six digits, without negative zeros.

    The grid is shifted by 3e-8, so a value that is an exact half does not depend on the last bit.
    """
    return df.select(*[
        (F.round(F.col(c) + 3e-8, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
        for c, kind in df.dtypes
    ])


def tidy(df: DataFrame, *names: str) -> DataFrame:
    """Columns cut to nine digits before binning, so bin edges do not depend on the last bit."""
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in names})


def supply_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as valued arcs between supplier and part numbers, loops included."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.lit("supply").alias(GRAPH),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000_000 + cents).alias("pos"),
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"),
        F.col("l_extendedprice").alias("value"),
    )


def parts_as_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n = part.select(F.count("*")).scalar()
    return part.select(F.lit("parts").alias(GRAPH), F.col("p_partkey").alias("id"), n.alias("n"))


# ---- sources and sinks


def _messy_edge_lines(spark, sf_dir) -> str:
    """Order lines written as messy text lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit(" # "), F.col("l_partkey"), F.lit(",1")))
        .when(F.col("l_linenumber") == 6, F.col("l_partkey").cast("string"))
        .when(F.col("l_linenumber") == 5, F.concat_ws(",", "l_partkey", "l_returnflag"))
        .when(F.col("l_linenumber") == 4, F.concat_ws(",", "l_partkey", "l_suppkey", "l_shipdate"))
        .when(F.col("l_linenumber") == 3, F.lit(""))
        .otherwise(F.concat(F.lit(" "), F.col("l_partkey"), F.lit(" , "), F.col("l_suppkey")))
        .alias("value")
    )
    path = staging_path(spark, "edge-csv")
    lines.write.text(path)
    return path


def scan_edge_csv(spark, sf_dir):
    return read_edge_csv(spark, _messy_edge_lines(spark, sf_dir)).select("u", "v").distinct()


def load_edge_list(spark, sf_dir):
    """The same lines by the data source, each file cut into ranges; a missing file is skipped."""
    path = _messy_edge_lines(spark, sf_dir)
    return load_edges(spark, [path, f"{path}-absent"], 1 << 16).select("u", "v").distinct()


def node_count(spark, sf_dir):
    return N.node_count(by_flag(spark, sf_dir))


def pairs_to_arcs(spark, sf_dir):
    return N.pairs_to_arcs(co_order(spark, sf_dir))


def _written_report(spark, sf_dir) -> str:
    path = staging_path(spark, "reports")
    S.write_report(A.edge_report(by_lot(spark, sf_dir)), path)
    return path


def report_parquet(spark, sf_dir):
    rows = S.read_report(spark, _written_report(spark, sf_dir))
    return rounded(rows.select(*EDGE_KEY, "n_tri", "n_quad", "bf", "or_lazy", "or_plain"))


def report_csv(spark, sf_dir):
    path = staging_path(spark, "reports-csv")
    S.write_report_csv(forman_table(N.prepare(by_flag(spark, sf_dir))), path)
    rows = S.read_report_csv(spark, path)
    return rounded(rows.select(*EDGE_KEY, "deg_u", "deg_v", "n_tri", "n_quad", "quad_cap", "bf"))


def report_for_tag(spark, sf_dir):
    path = staging_path(spark, "reports")
    S.write_report(forman_table(N.prepare(by_flag(spark, sf_dir))), path)
    return rounded(S.report_for_tag(S.read_report(spark, path), "flag_").select(*EDGE_KEY, "bf"))


def graph_sizes(spark, sf_dir):
    path = staging_path(spark, "reports-csv")
    S.write_report_csv(by_flag(spark, sf_dir), path)
    return S.graph_sizes(S.read_csv_text(spark, path))


def stored_sizes(spark, sf_dir):
    """Sizes of stored graphs from file footers."""
    path = staging_path(spark, "reports")
    S.write_report(by_flag(spark, sf_dir), path)
    return S.stored_sizes(spark, path)


def report_buckets(spark, sf_dir):
    """A report and a table of thresholds in buckets of the edge key, joined without a shuffle."""
    edges = stage(by_flag(spark, sf_dir), "edges")
    report = forman_table(N.prepare(edges)).select(*EDGE_KEY, "bf")
    given = edges.withColumn("x", F.col("u") / (F.col("v") + 1))
    tables = []
    for label, rows in (("forman", report), ("given", given)):
        path = staging_path(spark, label)
        tables.append(S.save_report_table(rows, path.rsplit("/", 1)[-1].replace("-", "_"), path, 8))
    return rounded(N.edgewise(tables[0], tables[1], "x"))


def stray_reports(spark, sf_dir):
    edges = by_flag(spark, sf_dir)
    first = edges.agg(F.min(GRAPH).alias("tag"))
    return S.stray_reports(edges, first)


def summary_json(spark, sf_dir):
    path = staging_path(spark, "summary")
    degreed = N.prepare(by_flag(spark, sf_dir))
    summary = Q.summarize_distribution(
        Q.long_metrics(degreed, ["deg_u", "deg_v"]), [GRAPH, "metric"])
    S.write_summary(
        summary.groupBy(GRAPH).agg(F.map_from_entries(F.collect_list(
            F.struct("metric", F.struct(*Q.STATISTICS)))).alias("summary")), path)
    text = spark.read.text(path)
    doc = F.from_json("value", f"summary MAP<STRING, {S.STATS}>")
    return rounded(text.select(F.col(GRAPH), F.explode(doc["summary"]).alias("metric", "s")).select(
        GRAPH, "metric", *[F.col("s")[c].alias(c) for c in Q.STATISTICS]))


def manifest_round_trip(spark, sf_dir):
    report, runs = R.run_suite(by_lot(spark, sf_dir))
    path = staging_path(spark, "manifest")
    S.write_manifest(runs, path)
    read = S.read_manifest(spark, path)
    return rounded(read.select("tag", "n", "m", F.explode("summary").alias("metric", "s")).select(
        "tag", "n", "m", "metric", *[F.col("s")[c].alias(c) for c in Q.STATISTICS]))


# ---- builders


def cycle(spark, sf_dir):
    return G.cycle_edges(parts_as_nodes(spark, sf_dir))


def _of_nodes(edges, spark, sf_dir):
    """Edges between ids of the table; a last row that is not full has no links to its gap."""
    return edges.filter(F.col("v") < F.lit(parts_as_nodes(spark, sf_dir).count()))


def grid(spark, sf_dir):
    edges = G.grid_edges(parts_as_nodes(spark, sf_dir), F.ceil(F.col("n") / 20), 20)
    return _of_nodes(edges, spark, sf_dir)


def torus(spark, sf_dir):
    edges = G.torus_edges(parts_as_nodes(spark, sf_dir), F.ceil(F.col("n") / 20), 20)
    return _of_nodes(edges, spark, sf_dir)


def tree(spark, sf_dir):
    return G.tree_edges(parts_as_nodes(spark, sf_dir), 3)


def complete(spark, sf_dir):
    """One complete graph per run of 16 parts."""
    nodes = parts_as_nodes(spark, sf_dir)
    block = F.floor(F.col("id") / 16)
    return G.complete_edges(nodes.select(
        F.concat(F.lit("block_"), block).alias(GRAPH), (F.col("id") % 16).alias("id"),
        F.least(F.lit(16), F.col("n") - block * 16).cast("bigint").alias("n"),
    ))


def bernoulli(spark, sf_dir):
    """Parts linked at random with about eight links each."""
    nodes = parts_as_nodes(spark, sf_dir)
    n = nodes.count()
    return G.bernoulli_edges(nodes, 8.0 / (n - 1), SEED, n - 1)


def _thirds(n: int) -> list[int]:
    return [n // 3, n // 3, n - 2 * (n // 3)]


def block_model(spark, sf_dir):
    nodes = parts_as_nodes(spark, sf_dir)
    n = nodes.count()
    odds = [[12.0 / n, 2.0 / n, 0.0], [2.0 / n, 9.0 / n, 4.0 / n], [0.0, 4.0 / n, 6.0 / n]]
    return G.block_edges(nodes, _thirds(n), odds, SEED)


def two_blocks(spark, sf_dir):
    nodes = parts_as_nodes(spark, sf_dir)
    n = nodes.count()
    return G.two_level_block_edges(nodes, G.halves(n), 12.0 / n, 4.0 / n, SEED)


def radius_graph(spark, sf_dir):
    points = G.uniform_points(parts_as_nodes(spark, sf_dir), SEED)
    return G.radius_edges(points, F.sqrt(F.lit(8.0) / (F.col("n") * math.pi)))


def hyperbolic_graph(spark, sf_dir):
    nodes = parts_as_nodes(spark, sf_dir)
    radius = 2.0 * math.log(nodes.count()) - 1.0
    return G.hyperbolic_edges(G.hyperbolic_points(nodes, radius, 0.9, SEED), radius, 0.9)


def soft_hyperbolic_graph(spark, sf_dir):
    """Hyperbolic links at a temperature; random in a way of its own, so without check SQL."""
    nodes = parts_as_nodes(spark, sf_dir)
    radius = 2.0 * math.log(nodes.count()) - 1.0
    points = G.hyperbolic_points(nodes, radius, 0.9, SEED)
    return G.soft_hyperbolic_edges(points, radius, 0.9, 0.5, SEED)


# ---- cleaning, adjacency, values


def canonical_edges(spark, sf_dir):
    return N.canonical_edges(supply_arcs(spark, sf_dir))


def neighbor_lists(spark, sf_dir):
    lists = N.neighbor_lists(co_order(spark, sf_dir))
    return lists.select(GRAPH, "s", F.array_join("ns", ",").alias("ns"))


def degrees(spark, sf_dir):
    return N.degrees(co_order(spark, sf_dir))


def arc_values(spark, sf_dir):
    arcs = stage(supply_arcs(spark, sf_dir), "arcs")
    edges = N.canonical_edges(arcs)
    out = edges
    for agg in N.ARC_AGGREGATES:
        values = N.arc_values_to_edges(edges, arcs, agg).withColumnRenamed("value", f"v_{agg}")
        out = out.join(values, EDGE_KEY)
    return rounded(out)


def edgewise_threshold(spark, sf_dir):
    degreed = prepared_all(spark, sf_dir)
    given = degreed.select(*EDGE_KEY, (F.col("u") / (F.col("v") + 1)).alias("x"))
    return rounded(N.edgewise(N.edgewise(degreed, 0.25, "zeta"), given, "theta"))


def bounded_distances(spark, sf_dir):
    edges = prepared_flags(spark, sf_dir)
    sources = N.degrees(edges).select(GRAPH, F.col("s").alias("source"))
    reached = N.bounded_distances(edges, sources, 3)
    return reached.groupBy(GRAPH, "source", "dist").agg(
        F.count("*").alias("nodes"), F.sum("node").alias("node_sum"))


def set_distances(spark, sf_dir):
    """Each line's part to a part chosen by its supplier, in the graph of its flag."""
    edges = by_flag(spark, sf_dir)
    n = table(spark, sf_dir, "part").select(F.count("*")).scalar()
    pairs = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("flag_"), F.col("l_returnflag")).alias(GRAPH), F.col("l_partkey").alias("source"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % n).alias("node")).distinct()
    return N.set_distances(stage(edges, "edges"), pairs, 3, 10)


def node_degrees(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(
        F.lit("co_order").alias(GRAPH), F.col("p_partkey").alias("s"))
    return N.node_degrees(nodes, co_order(spark, sf_dir))


# ---- local structure


def triangles(spark, sf_dir):
    return L.triangles_per_edge(prepared_all(spark, sf_dir))


def exclusive_neighbors(spark, sf_dir):
    return L.exclusive_neighbors(prepared_flags(spark, sf_dir))


def quads(spark, sf_dir):
    return L.quads(prepared_flags(spark, sf_dir))


def quad_nodes(spark, sf_dir):
    return L.quad_counts(prepared_flags(spark, sf_dir)).select(*EDGE_KEY, "n_quad")


def codegree_max(spark, sf_dir):
    return L.quad_counts(prepared_all(spark, sf_dir)).select(*EDGE_KEY, "codeg_max")


def quad_cap(spark, sf_dir):
    return L.local_structure(prepared_flags(spark, sf_dir)).select(*EDGE_KEY, "quad_cap")


def local_structure(spark, sf_dir):
    return L.local_structure(prepared_flags(spark, sf_dir))


# ---- transport


def cost_lazy(spark, sf_dir):
    return W.cost_table(prepared(spark, sf_dir), lazy=True)


def cost_plain(spark, sf_dir):
    return W.cost_table(prepared(spark, sf_dir), lazy=False)


def uniform_transport(spark, sf_dir):
    """Transport over the full lazy cost table; hop distances are a metric."""
    cost = W.cost_table(prepared(spark, sf_dir), lazy=True)
    return rounded(W.uniform_transport(cost, EDGE_KEY, "d", metric=True))


def _order_problems(spark, sf_dir):
    """Per order: quantity shares to price shares over line numbers, cost = lines apart."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("q"), F.sum(F.round(F.col("l_extendedprice") * 100)).alias("e"))
    totals = lines.groupBy("l_orderkey").agg(F.sum("q").alias("tq"), F.sum("e").alias("te"))
    shares = stage(lines.join(totals, "l_orderkey").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"),
        (F.col("q") / F.col("tq")).alias("sq"), (F.col("e") / F.col("te")).alias("se")), "shares")
    supply = shares.select("l_orderkey", F.col("line").alias("a"), F.col("sq").alias("mass"))
    demand = shares.select("l_orderkey", F.col("line").alias("b"), F.col("se").alias("mass"))
    cost = supply.select("l_orderkey", "a").join(demand.select("l_orderkey", "b"), "l_orderkey").select(
        "l_orderkey", "a", "b", F.abs(F.col("a") - F.col("b")).cast("double").alias("c"))
    return cost, supply, demand


def transport_value(spark, sf_dir):
    solved = W.solve_transport(*_order_problems(spark, sf_dir), ["l_orderkey"])
    return rounded(solved.values())


def transport_plan(spark, sf_dir):
    """Plans summed back to their supply side."""
    solved = W.solve_transport(*_order_problems(spark, sf_dir), ["l_orderkey"])
    return rounded(solved.plan().groupBy("l_orderkey", "a").agg(F.sum("flow").alias("mass")))


# ---- curvatures


def quad_term(spark, sf_dir):
    return rounded(forman_table(prepared_flags(spark, sf_dir)).select(*EDGE_KEY, "quad_term"))


def balanced_forman(spark, sf_dir):
    return rounded(forman_table(prepared_flags(spark, sf_dir)).select(*EDGE_KEY, "bf"))


def lazy_curvature(spark, sf_dir):
    return rounded(curvature_table(prepared(spark, sf_dir)).select(*EDGE_KEY, "or_lazy"))


def plain_curvature(spark, sf_dir):
    return rounded(curvature_table(prepared(spark, sf_dir)).select(*EDGE_KEY, "or_plain"))


def plain_curvature_reused(spark, sf_dir):
    """Plain curvature kept under its graphs' digests and read again by two consumers."""
    edges = stage(by_lot(spark, sf_dir), "edges")
    store = GraphStore(spark, staging_path(spark, "plain-store"))

    def compute(rows):
        return curvature_table(N.prepare(rows)).select(*EDGE_KEY, "or_plain")

    store.refresh(edges, compute)
    kept = store.refresh(edges, compute)
    mean = kept.groupBy(GRAPH).agg(F.avg("or_plain").alias("mean"))
    return rounded(kept.join(mean, GRAPH).groupBy(GRAPH).agg(
        F.count("*").alias("edges"), F.max("mean").alias("mean"),
        F.sum((F.col("or_plain") > F.col("mean")).cast("bigint")).alias("above")))


def all_curvatures(spark, sf_dir):
    return rounded(A.with_envelopes(curvature_table(prepared(spark, sf_dir))).select(
        *EDGE_KEY, "deg_u", "deg_v", "n_tri", "n_quad", "quad_cap", "quad_term", "bf", "or_lazy",
        "or_plain", "env_const", "env_slope"))


def degree_parameters(spark, sf_dir):
    t = L.local_structure(prepared_flags(spark, sf_dir))
    ru, ru_rev, rv, rv_rev = P.mass_excess("deg_u", "deg_v")
    return rounded(t.select(
        *EDGE_KEY,
        P.base_term("deg_u", "deg_v").alias("base_term"),
        P.tri_weight("deg_u", "deg_v").alias("tri_weight"),
        P.spread_term("deg_u", "deg_v").alias("spread_term"),
        P.tri_share_max("deg_u", "deg_v", "n_tri").alias("tri_share_max"),
        P.tri_share_min("deg_u", "deg_v", "n_tri").alias("tri_share_min"),
        P.laziness("deg_u").alias("laziness_u"),
        P.neighbor_mass("deg_v").alias("neighbor_mass_v"),
        P.mass_scale("deg_u", "deg_v").alias("mass_scale"),
        P.shared_mass("deg_u", "deg_v").alias("shared_mass"),
        ru.alias("excess_u"), ru_rev.alias("excess_u_rev"),
        rv.alias("excess_v"), rv_rev.alias("excess_v_rev"),
    ))


# ---- envelopes and bounds


def transport_envelope(spark, sf_dir):
    t = L.local_structure(prepared_flags(spark, sf_dir))
    parts = P.transport_envelope("deg_u", "deg_v", "n_tri", "n_quad")
    return rounded(t.withColumn("e", parts).select(*EDGE_KEY, "e.*"))


def const_slope(spark, sf_dir):
    t = prepared_flags(spark, sf_dir)
    return rounded(t.select(
        *EDGE_KEY, P.envelope_const("deg_u", "deg_v").alias("env_const"),
        P.envelope_slope("deg_u", "deg_v").alias("env_slope")))


def linear_envelope(spark, sf_dir):
    t = L.local_structure(prepared_flags(spark, sf_dir))
    return rounded(t.select(
        *EDGE_KEY, P.linear_envelope("deg_u", "deg_v", "n_tri").alias("at_tri"),
        P.linear_envelope("deg_u", "deg_v", F.lit(1.5)).alias("at_given")))


def lazy_lower(spark, sf_dir):
    t = curvature_table(prepared(spark, sf_dir))
    args = ("bf", "deg_u", "deg_v", "quad_term")
    return rounded(t.select(
        *EDGE_KEY, B.lazy_lower_from_forman(*args).alias("or_lo_blunt"),
        B.lazy_lower_from_forman(*args, F.col("or_plain")).alias("or_lo_sharp")))


def lazy_upper(spark, sf_dir):
    t = forman_table(prepared_flags(spark, sf_dir))
    return rounded(t.select(
        *EDGE_KEY, B.lazy_upper_from_forman("bf", "deg_u", "deg_v").alias("or_hi"),
        B.lazy_upper_from_forman(F.lit(0.25), "deg_u", "deg_v").alias("or_hi_given")))


def forman_lower(spark, sf_dir):
    t = curvature_table(prepared(spark, sf_dir))
    return rounded(t.select(
        *EDGE_KEY, B.forman_lower_from_lazy("or_lazy", "deg_u", "deg_v", "n_tri").alias("bf_lo"),
        B.forman_lower_from_lazy(F.lit(0.3), "deg_u", "deg_v", "n_tri").alias("bf_lo_given"),
        B.forman_lower_from_lazy(F.lit(0.3), "deg_u", "deg_v").alias("bf_lo_loose")))


def forman_upper(spark, sf_dir):
    t = curvature_table(prepared(spark, sf_dir))
    args = ("or_lazy", "deg_u", "deg_v", "quad_term")
    return rounded(t.select(
        *EDGE_KEY, B.forman_upper_from_lazy(*args).alias("bf_hi_blunt"),
        B.forman_upper_from_lazy(*args, F.col("or_plain")).alias("bf_hi_sharp")))


def tradeoff(spark, sf_dir):
    t = forman_table(prepared_flags(spark, sf_dir))
    floor = F.lit(0.5) * F.col("quad_term")
    return rounded(t.select(
        *EDGE_KEY, P.deg_min("deg_u", "deg_v").alias("small"),
        B.plain_tradeoff("deg_u", "deg_v", "n_tri", floor).alias("at_tri"),
        B.tradeoff_inverse("deg_u", "deg_v", F.lit(-0.2), floor).alias("t_max")))


def bounds_from_forman(spark, sf_dir):
    """Lazy band for a table of Balanced Forman thresholds."""
    t = stage(curvature_table(prepared(spark, sf_dir)), "curvature")
    given = t.select(*EDGE_KEY, (F.col("bf") * 0.5).alias("x"))
    return rounded(A.bounds_from_forman(t, given).select(*EDGE_KEY, "or_lo", "or_hi"))


def bounds_from_lazy(spark, sf_dir):
    """Forman band for one lazy threshold."""
    t = curvature_table(prepared(spark, sf_dir))
    return rounded(A.bounds_from_lazy(t, -0.1).select(*EDGE_KEY, "bf_lo", "bf_hi"))


# ---- entry points


def edge_report(spark, sf_dir):
    return rounded(A.edge_report(by_lot(spark, sf_dir)))


def analyze(spark, sf_dir):
    """Report and summary written, read back and counted."""
    summary_path = staging_path(spark, "summary")
    report = A.analyze(by_lot(spark, sf_dir), staging_path(spark, "report-csv"), summary_path)
    doc = F.from_json("value", f"summary MAP<STRING, {S.STATS}>")
    summary = spark.read.text(summary_path).select(GRAPH, doc["summary"]["bf"].alias("bf"))
    counted = report.groupBy(GRAPH).agg(F.count("*").alias("m"), F.avg("or_lazy").alias("mean_lazy"))
    return rounded(counted.join(summary, GRAPH).select(
        GRAPH, "m", "mean_lazy", F.col("bf.count").alias("bf_count"),
        F.col("bf.median").alias("bf_median")))


def updated_report(spark, sf_dir):
    """The report of all lots without the last month, brought to that of all lots without the first one."""
    lines = table(spark, sf_dir, "lineitem")
    first, last = (F.date_trunc("month", F.lit(x)) for x in lines.agg(F.min("l_shipdate"), F.max("l_shipdate")).first())
    old = stage(_lots(lines.filter(F.col("l_shipdate") < last)), "edges")
    new = stage(_lots(lines.filter(F.col("l_shipdate") >= F.add_months(first, 1))), "edges")
    report = stage(A.edge_report(old), "report")
    updated, _ = update_report(report, new.join(old, EDGE_KEY, "left_anti"), old.join(new, EDGE_KEY, "left_anti"))
    return rounded(updated.select(*EDGE_KEY, "n_tri", "n_quad", "quad_cap", "bf", "or_lazy", "or_plain"))


# ---- statistics


def _lot_report(spark, sf_dir) -> DataFrame:
    return stage(A.edge_report(by_lot(spark, sf_dir)), "report")


def sketch_summary(spark, sf_dir):
    """Summaries from sketches of graphs, merged for all of them; quantiles are held against exact ranks."""
    t = stage(forman_table(prepared_flags(spark, sf_dir)), "forman")
    values = stage(Q.long_metrics(t, ["bf", "n_tri", "n_quad", "quad_cap"]), "values")
    graphs = stage(Q.sketch_metrics(values, [GRAPH, "metric"]), "sketches")
    merged = Q.merge_sketches(graphs, ["metric"]).withColumn(GRAPH, F.lit("all"))
    summary = Q.summarize_sketches(graphs.unionByName(merged), [GRAPH, "metric"])
    points = summary.select(GRAPH, "metric", F.inline(F.array(*[
        F.struct(F.lit(p).alias("p"), F.col(name).alias("q")) for name, p in Q.SUMMARY_QUANTILES.items()])))
    every = values.unionByName(values.withColumn(GRAPH, F.lit("all")))
    ranks_of = every.join(F.broadcast(points), [GRAPH, "metric"]).groupBy(GRAPH, "metric", "p").agg(
        F.avg((F.col("value") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("q")).cast("double")).alias("upto"))
    slack = 3 * Q.sketch_rank_error()
    near = ranks_of.groupBy(GRAPH, "metric").agg(F.min((F.col("below") <= F.col("p") + slack) & (F.col("upto") >= F.col("p") - slack)).alias("near"))
    return rounded(summary.join(near, [GRAPH, "metric"]).select(GRAPH, "metric", "count", "mean", "std", "min", "max", "near"))


def distribution(spark, sf_dir):
    t = stage(forman_table(N.prepare(by_flag(spark, sf_dir))), "forman")
    return rounded(Q.summarize_distribution(
        Q.long_metrics(t, ["bf", "n_tri", "n_quad", "quad_cap"]), [GRAPH, "metric"]))


def slack(spark, sf_dir):
    rows = Q.with_slack(A.edge_report(by_lot(spark, sf_dir)))
    return rounded(rows.select(*EDGE_KEY, "env_slack", "theta_slack"))


def coverage(spark, sf_dir):
    return rounded(Q.coverage(A.edge_report(by_lot(spark, sf_dir))))


def band_widths(spark, sf_dir):
    return rounded(Q.band_widths(A.edge_report(by_lot(spark, sf_dir))))


def run_summary(spark, sf_dir):
    s = Q.summarize_run(_lot_report(spark, sf_dir))
    rest = ["or_in_band", "bf_in_band", "below_transport", "below_linear", "or_width", "bf_width"]
    return rounded(s.select(GRAPH, *rest, F.explode("summary").alias("metric", "s")).select(
        GRAPH, "metric", *rest, *[F.col("s")[c].alias(c) for c in Q.STATISTICS]))


def histogram(spark, sf_dir):
    t = stage(forman_table(N.prepare(by_flag(spark, sf_dir))), "forman")
    return rounded(Q.histogram(Q.long_metrics(tidy(t, "bf"), ["bf", "n_tri"]), [GRAPH, "metric"], "value", 60).select(
        GRAPH, "metric", "bin", "left", "right", "count"))


def density_histogram(spark, sf_dir):
    """Densities of the curvature and both ends of its band, each over its own range."""
    bands = ["or_lazy", "or_lo", "or_hi"]
    values = Q.long_metrics(tidy(_lot_report(spark, sf_dir), *bands), bands)
    return rounded(Q.histogram(values, [GRAPH, "metric"], "value", 40).select(
        GRAPH, "metric", "bin", "density"))


def bin_rules(spark, sf_dir):
    t = forman_table(N.prepare(by_flag(spark, sf_dir)))
    return Q.bin_counts(tidy(t, "bf"), [GRAPH], "bf")


def binned_quantiles(spark, sf_dir):
    t = stage(forman_table(N.prepare(by_flag(spark, sf_dir))), "forman")
    t = t.withColumn("deg_sum", (F.col("deg_u") + F.col("deg_v")).cast("double"))
    out = Q.binned_quantiles(t, [GRAPH], "deg_sum", ["bf"])
    return rounded(out)


def ribbon(spark, sf_dir):
    return rounded(Q.ribbon(tidy(_lot_report(spark, sf_dir), "bf")))


def histogram_2d(spark, sf_dir):
    t = tidy(_lot_report(spark, sf_dir), "bf", "or_lazy")
    return Q.histogram_2d(t, [GRAPH], "bf", "or_lazy", 30)


def quantile_profile(spark, sf_dir):
    t = stage(forman_table(N.prepare(by_flag(spark, sf_dir))).withColumn(
        "bf", F.round("bf", 6) + F.lit(0.0)), "forman")
    return rounded(ranks.quantile_profile(t, [GRAPH], "bf"))


def quantile_grid(spark, sf_dir):
    t = stage(forman_table(N.prepare(by_flag(spark, sf_dir))), "forman")
    return rounded(Q.quantile_grid(t, [GRAPH], "bf", 50))


def seeded_sample(spark, sf_dir):
    return Q.seeded_sample(co_order(spark, sf_dir), 25_000, SEED)


def tolerant_series(spark, sf_dir):
    """Series whose column exists; a table of structure alone has no band."""
    t = forman_table(prepared_flags(spark, sf_dir))
    present = Q.available(t, ["bf", "or_lazy", "or_lo", "quad_term"])
    return rounded(Q.long_metrics(t, present).groupBy(GRAPH, "metric").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean")))


# ---- suites


def _chosen_rows(spark, sf_dir) -> DataFrame:
    """Grids and random graphs picked from part sizes and numbers."""
    part = table(spark, sf_dir, "part")
    grids = part.select(F.lit("grid").alias("family"), F.array(
        F.col("p_size").cast("double"), (F.col("p_partkey") % 7 + 2).cast("double")).alias("params"))
    randoms = part.select(F.lit("er").alias("family"), F.array(
        (F.col("p_partkey") + 10).cast("double"),
        (F.col("p_partkey") % 90 + 10) / 10000.0).alias("params"))
    return grids.unionByName(randoms).distinct()


def suite_rows(spark, sf_dir):
    rows = R.resolve_suite(R.preset_rows(spark, "small"), _chosen_rows(spark, sf_dir))
    return rows.groupBy("family").agg(
        F.count("*").alias("graphs"), F.round(F.sum(F.element_at("params", 1)), 6).alias("first_sum"))


def tags(spark, sf_dir):
    rows = R.resolve_suite(R.preset_rows(spark, "paper"), _chosen_rows(spark, sf_dir))
    return rows.select("family", R.tag_of(F.col("family"), F.col("params")).alias("tag"))


def display_names(spark, sf_dir):
    rows = R.resolve_suite(R.preset_rows(spark, "paper"), _chosen_rows(spark, sf_dir))
    tag = R.tag_of(F.col("family"), F.col("params"))
    extra = table(spark, sf_dir, "part").select(
        F.concat(F.lit("real_"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))).alias("tag"))
    named = rows.select(tag.alias("tag")).unionByName(extra).distinct()
    return named.select("tag", R.display_name(F.col("tag")).alias("name"))


def resume(spark, sf_dir):
    """One flag is done already: the others run, its old summary stays."""
    edges = stage(by_lot(spark, sf_dir), "edges")
    first = edges.agg(F.min(GRAPH).alias(GRAPH))
    old_report, old_runs = R.run_suite(edges.join(first, GRAPH, "left_semi"))
    new_report, runs = R.resume_suite(edges, old_report, old_runs)
    redone = new_report.groupBy(F.col(GRAPH).alias("tag")).agg(F.count("*").alias("redone"))
    return rounded(runs.join(redone, "tag", "left").select(
        "tag", "n", "m", F.coalesce("redone", F.lit(0).cast("bigint")).alias("redone"),
        F.try_element_at("summary", F.lit("bf"))["mean"].alias("mean_bf")))


def suite_manifest(spark, sf_dir):
    _, runs = R.run_suite(by_lot(spark, sf_dir))
    return rounded(runs.select("tag", "n", "m", *[
        F.try_element_at("summary", F.lit(metric))["mean"].alias(f"mean_{metric}")
        for metric in ("or_lazy", "bf", "n_tri", "n_quad")]))


def published_suite(spark, sf_dir):
    """The manifest of reports published in three parts, each graph's marker last."""
    store = GraphStore(spark, staging_path(spark, "suite-store"))
    report = stage(store.refresh(by_lot(spark, sf_dir), A.edge_report, parts=3), "suite-report")
    runs = R.manifest(report)
    return rounded(runs.select("tag", "n", "m", *[
        F.try_element_at("summary", F.lit(metric))["mean"].alias(f"mean_{metric}")
        for metric in ("or_lazy", "bf", "n_tri", "n_quad")]))


QUERIES = {f.__name__: f for f in [
    edge_report, scan_edge_csv, node_count, pairs_to_arcs, report_parquet, report_csv,
    report_for_tag, graph_sizes, stray_reports, summary_json, manifest_round_trip,
    cycle, grid, torus, tree, complete, radius_graph, canonical_edges, neighbor_lists, degrees, arc_values, edgewise_threshold,
    bounded_distances, set_distances, node_degrees, triangles, exclusive_neighbors, quads,
    quad_nodes, codegree_max, quad_cap, local_structure, cost_lazy, cost_plain,
    uniform_transport, transport_value, transport_plan, quad_term, balanced_forman,
    lazy_curvature, plain_curvature, plain_curvature_reused, all_curvatures, degree_parameters,
    transport_envelope, const_slope, linear_envelope, lazy_lower, lazy_upper, forman_lower,
    forman_upper, tradeoff, bounds_from_forman, bounds_from_lazy, analyze, distribution, slack,
    coverage, band_widths, run_summary, histogram, density_histogram, bin_rules,
    binned_quantiles, ribbon, histogram_2d, quantile_profile, quantile_grid, seeded_sample,
    tolerant_series, suite_rows, tags, display_names, resume, suite_manifest,
    load_edge_list, stored_sizes, report_buckets, sketch_summary, updated_report, published_suite,
]}
