"""Exact optimal transport per edge.

For an edge with ends ``a`` (higher degree) and ``b``, both neighbourhood measures are cut down to
what has to move. Hop distance is a metric, so shared mass stays where it is and costs nothing.
What remains goes from the nodes next to ``a`` only to ``a``, ``b``, the common neighbours and the
nodes next to ``b`` only, over default distances 1, 2, 2 and 3. Everything below the default comes
from *near cells*: pairs of support nodes that are adjacent or share a neighbour. Spark finds the
near cells by joins; edges without any are solved by a column expression, the others by a small
integer flow over their cells. With ``deg_a + 1`` units per node of b and ``deg_b + 1`` per node
of a, all amounts are integers and the values do not depend on tolerances or row order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..columns import EDGE_KEY, GRAPH
from .clean import adjacency
from .flow import best_savings
from .local import HEAVY_DEGREE, arcs_to_heavy, arcs_with_degree, has_heavy, light_wedges, short_lists

SAVED = T.StructType([T.StructField("lazy", T.LongType()), T.StructField("plain", T.LongType())])


def by_degree(degreed: DataFrame) -> DataFrame:
    """Edges with their ends named by degree: ``a`` the higher one, ``b`` the lower one."""
    swap = F.col("deg_u") < F.col("deg_v")
    return degreed.select(
        *EDGE_KEY,
        F.when(swap, F.col("v")).otherwise(F.col("u")).alias("a"),
        F.when(swap, F.col("u")).otherwise(F.col("v")).alias("b"),
        F.greatest("deg_u", "deg_v").alias("deg_a"),
        F.least("deg_u", "deg_v").alias("deg_b"),
    )


def near_pairs(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """Pairs ``(graph_id, p, q, dist)``, p < q, at distance 1, or 2 through a node of small degree.

    A middle node of degree k adds k(k-1)/2 pairs; nodes above ``heavy_degree`` are left out, so
    the table stays within ``heavy_degree`` times the number of edges.
    """
    wedges = light_wedges(degreed, heavy_degree).select(GRAPH, "p", "q", F.lit(2).alias("dist"))
    adjacent = degreed.select(
        GRAPH, F.col("u").alias("p"), F.col("v").alias("q"), F.lit(1).alias("dist")
    )
    return adjacent.unionByName(wedges).groupBy(GRAPH, "p", "q").agg(F.min("dist").alias("dist"))


def _light_cells(edges: DataFrame, near: DataFrame, lists: DataFrame) -> DataFrame:
    """Near cells of edges whose ends both have small degree, from their neighbour arrays."""
    with_lists = edges.join(
        lists.select(GRAPH, F.col("s").alias("a"), F.col("ns").alias("around_a")), [GRAPH, "a"]
    ).join(
        lists.select(GRAPH, F.col("s").alias("b"), F.col("ns").alias("around_b")), [GRAPH, "b"]
    )
    both = F.array_intersect("around_a", "around_b")
    only_b = F.array_except("around_b", F.array_append("around_a", F.col("a")))
    only_a = F.array_except("around_a", F.array_append("around_b", F.col("b")))
    right = F.concat(
        F.transform(only_b, lambda x: F.struct(x.alias("r"), F.lit(False).alias("common"))),
        F.when(F.col("deg_a") > F.col("deg_b"),
               F.transform(both, lambda x: F.struct(x.alias("r"), F.lit(True).alias("common"))))
        .otherwise(F.array()),
    )
    pairs = (
        with_lists.select(*EDGE_KEY, only_a.alias("only_a"), right.alias("right"))
        .select(*EDGE_KEY, "only_a", F.inline("right"))
        .select(*EDGE_KEY, F.explode("only_a").alias("l"), "r", "common")
        .withColumn("p", F.least("l", "r"))
        .withColumn("q", F.greatest("l", "r"))
    )
    return pairs.join(near, [GRAPH, "p", "q"]).select(*EDGE_KEY, "l", "r", "common", "dist")


def _met_at_heavy(edges: DataFrame, degreed: DataFrame, heavy_degree: int) -> DataFrame:
    """Cells of small-degree edges whose nodes meet at a heavy node: distance 2 at most.

    ``(edge, l)`` and ``(edge, r)`` are matched on the edge and the heavy node, so the heavy
    node's own neighbour list is never expanded.
    """
    short = arcs_with_degree(degreed).filter(F.col("deg_s") <= heavy_degree)
    to_heavy = arcs_to_heavy(degreed, heavy_degree)

    def side(end: str, other: str, name: str) -> DataFrame:
        around = short.select(GRAPH, F.col("s").alias(end), F.col("d").alias("node"))
        beyond = short.select(GRAPH, F.col("s").alias(other), F.col("d").alias("node"))
        return (
            edges.join(around, [GRAPH, end])
            .join(to_heavy, [GRAPH, "node"])
            .filter(F.col("node") != F.col(other))
            .join(beyond, [GRAPH, other, "node"], "left_anti")
            .select(*EDGE_KEY, "hub", F.col("node").alias(name))
        )

    return side("a", "b", "l").join(side("b", "a", "r"), EDGE_KEY + ["hub"]).select(
        *EDGE_KEY, "l", "r", F.lit(False).alias("common"), F.lit(2).alias("dist")
    )


def _heavy_cells(
    edges: DataFrame, degreed: DataFrame, near: DataFrame, heavy_degree: int
) -> DataFrame:
    """Near cells of edges at a heavy end, walked outwards from the lower-degree end.

    The heavy end's neighbours are only probed, by the key (heavy node, neighbour). Two heavy nodes
    meet through the table of nodes next to both, which each such node builds from its own list.
    """
    arcs = adjacency(degreed)
    around_b = arcs.select(GRAPH, F.col("s").alias("b"), F.col("d").alias("r"))
    at_a = arcs.select(GRAPH, F.col("s").alias("a"), F.col("d").alias("r"),
                       F.lit(True).alias("common"))
    right = (
        edges.join(around_b, [GRAPH, "b"])
        .filter(F.col("r") != F.col("a"))
        .join(at_a, [GRAPH, "a", "r"], "left")
        .withColumn("common", F.coalesce("common", F.lit(False)))
    )
    both_ways = near.select(GRAPH, F.col("p").alias("r"), F.col("q").alias("l"), "dist").unionByName(
        near.select(GRAPH, F.col("q").alias("r"), F.col("p").alias("l"), "dist")
    )
    to_heavy = arcs_to_heavy(degreed, heavy_degree)
    shared = (
        to_heavy.withColumnsRenamed({"node": "l", "hub": "a"})
        .join(to_heavy.withColumnRenamed("node", "l"), [GRAPH, "l"])
        .filter(F.col("a") != F.col("hub"))
    )
    through_heavy = (
        right.filter(~F.col("common"))
        .join(to_heavy.withColumnRenamed("node", "r"), [GRAPH, "r"])
        .join(shared, [GRAPH, "a", "hub"])
        .withColumn("dist", F.lit(2))
    )
    columns = [*EDGE_KEY, "a", "b", "l", "r", "common", "dist"]
    reached = right.join(both_ways, [GRAPH, "r"]).select(*columns).unionByName(
        through_heavy.select(*columns)
    )
    next_to_a = arcs.select(GRAPH, F.col("s").alias("a"), F.col("d").alias("l"))
    next_to_b = arcs.select(GRAPH, F.col("s").alias("b"), F.col("d").alias("l"))
    return (
        reached.filter((F.col("l") != F.col("a")) & (F.col("l") != F.col("b"))
                       & (F.col("l") != F.col("r")))
        .join(next_to_a, [GRAPH, "a", "l"], "left_semi")
        .join(next_to_b, [GRAPH, "b", "l"], "left_anti")
        .select(*EDGE_KEY, "l", "r", "common", "dist")
    )


def near_cells(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """Support pairs closer than their default distance: ``(edge, l, r, common, saving)``.

    ``l`` is next to the higher-degree end only; ``r`` is next to the other end only, or to both
    (``common``). ``saving`` is the default distance less the true one.
    """
    edges = by_degree(degreed)
    near = near_pairs(degreed, heavy_degree)
    short = edges.filter(F.col("deg_a") <= heavy_degree)
    cells = _light_cells(short, near, short_lists(degreed, heavy_degree))
    if has_heavy(degreed, heavy_degree):
        at_heavy = edges.filter(F.col("deg_a") > heavy_degree)
        cells = (
            cells.unionByName(_met_at_heavy(short, degreed, heavy_degree))
            .unionByName(_heavy_cells(at_heavy, degreed, near, heavy_degree))
            .groupBy(*EDGE_KEY, "l", "r", "common")
            .agg(F.min("dist").alias("dist"))
        )
    default = F.when(F.col("common"), 2).otherwise(3)
    return cells.withColumn("saving", default - F.col("dist")).filter(F.col("saving") > 0).select(
        *EDGE_KEY, "l", "r", "common", "saving"
    )


def cell_classes(cells: DataFrame) -> DataFrame:
    """Per edge, the distinct cell rows of the left side with the number of nodes sharing each.

    A cell is packed as ``4 r + 2 common + (saving - 1)``. Left nodes with equal rows are merged
    before anything is collected, so many alike neighbours of a hub become one class.
    """
    packed = (F.col("r") * 4 + F.col("common").cast("int") * 2 + F.col("saving") - 1).cast("long")
    rows = cells.groupBy(*EDGE_KEY, "l").agg(F.sort_array(F.collect_list(packed)).alias("row"))
    counted = rows.groupBy(*EDGE_KEY, "row").agg(F.count("*").alias("nodes"))
    return counted.groupBy(*EDGE_KEY).agg(
        F.collect_list(F.struct("row", "nodes")).alias("classes")
    )


@F.arrow_udf(SAVED)
def _flow_savings(deg_a: pa.Array, deg_b: pa.Array, tri: pa.Array, classes: pa.Array) -> pa.Array:
    lazy, plain = [], []
    for da, db, t, rows in zip(deg_a.to_pylist(), deg_b.to_pylist(), tri.to_pylist(),
                               classes.to_pylist()):
        won = best_savings(da, db, t, [(c["row"], c["nodes"]) for c in rows]) if rows else (0, 0)
        lazy.append(won[0])
        plain.append(won[1])
    return pa.StructArray.from_arrays(
        [pa.array(lazy, pa.int64()), pa.array(plain, pa.int64())], ["lazy", "plain"]
    )


def lazy_value(deg_a: Column, deg_b: Column, tri: Column, saved: Column) -> Column:
    """Lazy curvature from the integer saving over default distances."""
    gap = deg_a - deg_b
    base = gap * (tri * 2 + 3) + (deg_b - 1 - tri) * (deg_a + 1) * 3
    units = (deg_a + 1) * (deg_b + 1)
    return F.lit(1.0) - (base - saved).cast("double") / units


def plain_value(deg_a: Column, deg_b: Column, tri: Column, saved: Column) -> Column:
    """Non-lazy curvature from the integer saving over default distances."""
    gap = deg_a - deg_b
    base = deg_a + gap * tri * 2 + (deg_b - 1 - tri) * deg_a * 3
    return F.lit(1.0) - (base - saved).cast("double") / (deg_a * deg_b)


def plain_saving_without_cells(deg_a: Column, deg_b: Column, tri: Column) -> Column:
    """What the mass at b saves when no near cell exists: b is next to its own neighbours."""
    return F.when(deg_b - 1 - tri > 0, deg_b * 2).otherwise(
        F.least(deg_b, tri * (deg_a - deg_b))
    )


def with_transport(local: DataFrame, degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """Add ``or_lazy`` and ``or_plain`` to a table of local structure."""
    classes = cell_classes(near_cells(degreed, heavy_degree))
    deg_a, deg_b = F.greatest("deg_u", "deg_v"), F.least("deg_u", "deg_v")
    tri = F.col("n_tri")
    saved = _flow_savings(deg_a, deg_b, tri, F.col("classes"))
    kept = [c for c in local.columns]
    solved = local.join(classes, EDGE_KEY, "left").select(
        *kept, F.col("classes").isNull().alias("free"), saved.alias("saved")
    )
    lazy = lazy_value(deg_a, deg_b, tri, F.col("saved.lazy"))
    plain = plain_value(deg_a, deg_b, tri, F.when(
        F.col("free"), plain_saving_without_cells(deg_a, deg_b, tri)
    ).otherwise(F.col("saved.plain")))
    return solved.select(*kept, lazy.alias("or_lazy"), plain.alias("or_plain"))
