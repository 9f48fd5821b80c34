"""Triangles and 4-cycles per edge.

Nodes are ranked by ``(degree, id)``. A triangle is found from its lowest node and a 4-cycle from
its highest one, each exactly once. The intermediate wedges number at most the sum of the smaller
degree over all edges, so a hub never expands its own neighbour list.

Triangles and 4-cycles are listed by :func:`triangles` and :func:`quads` only. Counts per edge are made in
blocks of nodes, without wedges as rows; those of 4-cycles come from codegrees: see :func:`quad_counts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import EDGE_KEY, GRAPH
from ..staging import scratch, stage, stage_at, staging_path
from . import blocks
from .clean import ARCS_PER_KEY


#: Neighbours, or edges, of one node that a key takes.
TILE = 1024
#: Nodes above this degree are heavy: they are never turned into a neighbour array.
HEAVY_DEGREE = 512


def has_heavy(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> bool:
    """Whether any node lies above ``heavy_degree``."""
    return degreed.filter(F.greatest("deg_u", "deg_v") > heavy_degree).limit(1).count() > 0


def _below(deg_a, a, deg_b, b) -> Column:
    deg_a, a, deg_b, b = (F.col(c) for c in (deg_a, a, deg_b, b))
    return (deg_a < deg_b) | ((deg_a == deg_b) & (a < b))


def _shares(degree: str) -> Column:
    return (F.floor(F.col(degree) / ARCS_PER_KEY) + 1).cast("int")


def short_lists(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """Sorted neighbour arrays of the nodes with degree up to ``heavy_degree`` only."""
    return (
        arcs_with_degree(degreed)
        .filter(F.col("deg_s") <= heavy_degree)
        .groupBy(GRAPH, "s")
        .agg(F.sort_array(F.collect_list("d")).alias("ns"))
    )


def light_wedges(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """``(graph_id, c, p, q)``: pairs p < q of neighbours of each node c of small degree.

    A node of degree k adds k(k-1)/2 rows, so there are at most ``heavy_degree`` times the edges.
    """
    lists = short_lists(degreed, heavy_degree).filter(F.size("ns") > 1)
    return lists.select(GRAPH, F.col("s").alias("c"), "ns", F.posexplode("ns").alias("at", "p")).select(
        GRAPH, "c", "p", F.explode(F.expr("slice(ns, at + 2, size(ns))")).alias("q"))


def arcs_to_heavy(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """``(graph_id, node, hub)``: every node next to a heavy one."""
    return arcs_with_degree(degreed).filter(F.col("deg_d") > heavy_degree).select(
        GRAPH, F.col("s").alias("node"), F.col("d").alias("hub"))


def upward_arcs(degreed: DataFrame) -> DataFrame:
    """Each edge once, from its lower-ranked end ``lo`` to its higher-ranked end ``hi``."""
    u_first = _below("deg_u", "u", "deg_v", "v")
    return degreed.select(
        GRAPH,
        F.when(u_first, F.col("u")).otherwise(F.col("v")).alias("lo"),
        F.when(u_first, F.col("v")).otherwise(F.col("u")).alias("hi"),
        F.when(u_first, F.col("deg_u")).otherwise(F.col("deg_v")).alias("deg_lo"),
        F.when(u_first, F.col("deg_v")).otherwise(F.col("deg_u")).alias("deg_hi"),
    )


def arcs_with_degree(degreed: DataFrame) -> DataFrame:
    """Both directions with both degrees: ``(graph_id, s, d, deg_s, deg_d)``."""
    ends = F.array(*[
        F.struct(F.col(s).alias("s"), F.col(d).alias("d"),
                 F.col(f"deg_{s}").alias("deg_s"), F.col(f"deg_{d}").alias("deg_d"))
        for s, d in (("u", "v"), ("v", "u"))
    ])
    return degreed.select(GRAPH, F.inline(ends))


def _edge_of(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def triangles(degreed: DataFrame, lowest: DataFrame | None = None) -> DataFrame:
    """Every triangle once: ``(graph_id, x, y, z)`` in rank order; only those from nodes ``(graph_id, x)`` if given."""
    up = upward_arcs(degreed)
    start = up if lowest is None else up.join(lowest.withColumnRenamed("x", "lo"), [GRAPH, "lo"], "left_semi")
    first = start.select(GRAPH, F.col("lo").alias("x"), F.col("hi").alias("y"),
                      F.col("deg_hi").alias("deg_y"))
    second = up.select(GRAPH, F.col("lo").alias("x"), F.col("hi").alias("z"),
                       F.col("deg_hi").alias("deg_z"))
    closing = up.select(GRAPH, F.col("lo").alias("y"), F.col("hi").alias("z"))
    wedges = first.join(second, [GRAPH, "x"]).filter(_below("deg_y", "y", "deg_z", "z"))
    return wedges.join(closing, [GRAPH, "y", "z"]).select(GRAPH, "x", "y", "z")


def triangles_per_edge(degreed: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """``(graph_id, u, v, n_tri)`` for edges that have triangles.

    They are counted in blocks of lowest nodes; those of a node with more than ``block`` wedges are listed.
    """
    # A node has at most 2 * edges / degree neighbours of its degree or more.
    most = F.least(F.col("deg_hi"), F.lit(2.0 * degreed.count()) / F.col("deg_hi")).cast("double")
    up = upward_arcs(degreed).select(GRAPH, F.col("lo").alias("s"), F.col("hi").alias("d"), most.alias("load"))
    path = staging_path(degreed.sparkSession, "found")
    with scratch(degreed.sparkSession):
        lists = blocks.packed_lists(up)
        above = blocks.packed_lists(up.select(GRAPH, F.col("d").alias("s"), F.col("s").alias("d"), "load"))
        own, large, _ = blocks.in_blocks(lists, block)
        found = blocks.triangle_counts(lists, above, own, f"{path}/blocks").withColumnRenamed("n", "n_tri")
        if large.isEmpty():
            return found
        large = stage_at(large, f"{path}/large")
    sides = F.array(*[F.struct(*_edge_of(a, b)) for a, b in (("x", "y"), ("x", "z"), ("y", "z"))])
    listed = triangles(degreed, large.select(GRAPH, F.col("node").alias("x")))
    listed = listed.select(GRAPH, F.inline(sides)).withColumn("n_tri", F.lit(1).cast("long"))
    return found.unionByName(listed).groupBy(*EDGE_KEY).agg(F.sum("n_tri").alias("n_tri"))


def four_cycles(degreed: DataFrame) -> DataFrame:
    """Every 4-cycle ``top - p - far - q - top`` once.

    ``chord_ends`` tells whether top and far are adjacent, ``chord_mid`` whether p and q are.
    """
    # The arcs of a large middle node are dealt out over several keys by its known degree; its few
    # higher neighbours (at most 2 * edges / degree) are copied to each of them.
    up = upward_arcs(degreed)
    climb = up.select(
        GRAPH, F.col("lo").alias("mid"), F.col("hi").alias("top"), F.col("deg_hi").alias("deg_top"),
        F.explode(F.sequence(F.lit(0), _shares("deg_lo") - 1)).alias("share"),
    )
    step = arcs_with_degree(degreed).select(
        GRAPH, F.col("s").alias("mid"), F.col("d").alias("far"), F.col("deg_d").alias("deg_far"),
        F.pmod(F.xxhash64("d"), _shares("deg_s")).cast("int").alias("share"),
    )
    wedges = (
        climb.join(step, [GRAPH, "mid", "share"])
        .filter(_below("deg_far", "far", "deg_top", "top"))
        .select(GRAPH, "top", "far", "mid")
    )
    p = wedges.withColumnRenamed("mid", "p")
    q = wedges.withColumnRenamed("mid", "q")
    cycles = p.join(q, [GRAPH, "top", "far"]).filter(F.col("p") < F.col("q"))
    edge = degreed.select(*EDGE_KEY)
    ends = edge.select(GRAPH, F.col("u").alias("end_lo"), F.col("v").alias("end_hi"),
                       F.lit(True).alias("chord_ends"))
    mids = edge.select(GRAPH, F.col("u").alias("p"), F.col("v").alias("q"),
                       F.lit(True).alias("chord_mid"))
    return (
        cycles.withColumn("end_lo", F.least("top", "far"))
        .withColumn("end_hi", F.greatest("top", "far"))
        .join(ends, [GRAPH, "end_lo", "end_hi"], "left")
        .join(mids, [GRAPH, "p", "q"], "left")
        .select(GRAPH, "top", "p", "far", "q",
                F.coalesce("chord_ends", F.lit(False)).alias("chord_ends"),
                F.coalesce("chord_mid", F.lit(False)).alias("chord_mid"))
    )


def quads(degreed: DataFrame) -> DataFrame:
    """Quad table ``(graph_id, u, v, k, w, excl)``: k next to u, w next to v, k next to w.

    ``excl`` holds when k is not next to v and w is not next to u, that is when the 4-cycle
    ``u - k - w - v`` has no chord.
    """
    ring = ["top", "p", "far", "q"]
    rows = []
    for at in range(4):
        before, a, b, after = (F.col(ring[(at + shift) % 4]) for shift in range(4))
        rows.append(F.struct(
            F.least(a, b).alias("u"), F.greatest(a, b).alias("v"),
            F.when(a < b, before).otherwise(after).alias("k"),
            F.when(a < b, after).otherwise(before).alias("w"),
            (~F.col("chord_ends") & ~F.col("chord_mid")).alias("excl"),
        ))
    return four_cycles(degreed).select(GRAPH, F.inline(F.array(*rows)))


def corners(degreed: DataFrame) -> DataFrame:
    """Every triangle from each of its nodes: ``(graph_id, c, p, q)``, p < q."""
    views = F.array(*[
        F.struct(F.col(c).alias("c"), F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
        for c, a, b in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))
    ])
    return triangles(degreed).select(GRAPH, F.inline(views))


def _chords(corner: DataFrame, heavy: DataFrame) -> DataFrame:
    """``(graph_id, c, p, q, closed, common)``: whether p and q touch, and how many nodes touch all three.

    Both come from triangles at c. A node counted for a heavy c is a light one, so the triangles
    met on one edge number at most the smaller degree of its ends.
    """
    half = corner.select(GRAPH, "c", F.inline(F.array(
        F.struct(F.col("p").alias("x"), F.col("q").alias("o")), F.struct(F.col("q").alias("x"), F.col("p").alias("o")))))
    ends = heavy.select(GRAPH, F.col("node").alias("c")), heavy.select(GRAPH, F.col("node").alias("x"))
    both = half.join(ends[0], [GRAPH, "c"], "left_semi").join(ends[1], [GRAPH, "x"], "left_semi")
    half = half.join(both.select(GRAPH, "c", "x").distinct(), [GRAPH, "c", "x"], "left_anti")
    left, right = half.withColumnRenamed("o", "p"), half.withColumnRenamed("o", "q")
    common = left.join(right, [GRAPH, "c", "x"]).filter(F.col("p") < F.col("q")).select(
        GRAPH, "c", "p", "q", F.lit(0).alias("closed"), F.lit(1).alias("common"))
    closed = corner.select(GRAPH, "c", "p", "q", F.lit(1).alias("closed"), F.lit(0).alias("common"))
    return closed.unionByName(common).groupBy(GRAPH, "c", "p", "q").agg(
        F.max("closed").alias("closed"), F.sum("common").alias("common"))


def _seen_from(a: str, b: str, through: Column, is_open: Column) -> Column:
    """What one further node adds to the edge of ``a`` and ``b``."""
    return F.struct(*_edge_of(a, b), through.cast("long").alias("through"), is_open.cast("long").alias("open"))


def quad_counts(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """``(graph_id, u, v, n_quad, codeg_max)`` for edges that lie on a 4-cycle.

    ``n_quad`` counts nodes of either exclusive neighbourhood that touch the other one;
    ``codeg_max`` is the largest number of 4-cycles through the edge and one further node.

    Neither needs the cycles. For an edge (c, p) and a further neighbour q of c, the cycles through
    them are the other common neighbours of p and q: their codegree less one. One of these has no
    chord if p and q do not touch and not all of them touch c, which the triangles at c count. So the
    wedges at c meet the codegrees of their ends once. In a graph without heavy nodes both are made in blocks
    of nodes, in arrays.

    In the others, wedges are made at light nodes only. Common neighbours that are heavy are counted from the set of
    heavy neighbours that every node carries, and what a heavy c adds depends on that set alone but
    for corrections found at light nodes. Nodes of equal sets are one class, so two hubs that share
    many neighbours cost a row for each of these, not for each pair of them. What remains grows with the
    pairs of different sets of heavy neighbours that have two hubs in common.
    """
    light, hubby = _by_hubs(degreed, heavy_degree)
    seen = _seen_in_blocks(light, ["through", "open"]).select(*EDGE_KEY, F.col("open").alias("n_quad"), F.col("through").alias("codeg_max"))
    if hubby is not None:
        seen = seen.unionByName(_seen_with_heavy(hubby, heavy_degree).groupBy(*EDGE_KEY).agg(
            F.sum("open").alias("n_quad"), F.max("through").alias("codeg_max")))
    return seen.filter("codeg_max > 0")


def _by_hubs(degreed: DataFrame, heavy_degree: int) -> tuple[DataFrame, DataFrame | None]:
    """The edges of graphs without heavy nodes, and those of the others if there are any."""
    if not has_heavy(degreed, heavy_degree):
        return degreed, None
    hubby = F.broadcast(degreed.filter(F.greatest("deg_u", "deg_v") > heavy_degree).select(GRAPH).distinct())
    return degreed.join(hubby, GRAPH, "left_anti"), degreed.join(hubby, GRAPH, "left_semi")


def _seen_in_blocks(degreed: DataFrame, columns: list[str]) -> DataFrame:
    """Degrees, common neighbours and what the further neighbours of both ends add to each edge: see :func:`blocks.codegree_counts`.

    For graphs without heavy nodes.
    """
    path = staging_path(degreed.sparkSession, "seen")
    with scratch(degreed.sparkSession):
        lists = blocks.packed_lists(arcs_with_degree(degreed).select(GRAPH, "s", "d", F.col("deg_d").cast("double").alias("load")))
        own, _, _ = blocks.in_blocks(lists)
        return blocks.codegree_counts(lists, own, path, columns)


def _seen_with_heavy(degreed: DataFrame, heavy_degree: int) -> DataFrame:
    """The same by joins of wedges at light nodes and of sets of heavy neighbours."""
    wedges = light_wedges(degreed, heavy_degree)
    shared = wedges.groupBy(GRAPH, "p", "q").agg(F.count("*").alias("shared"))
    heavy = arcs_to_heavy(degreed, heavy_degree)
    hubs = stage(heavy.groupBy(GRAPH, "node").agg(F.sort_array(F.collect_list("hub")).alias("hubs")), "hubs")
    corner = stage(corners(degreed), "corners")
    chords = stage(_chords(corner, heavy.select(GRAPH, F.col("hub").alias("node")).distinct()), "chords")
    met = stage(_with_hubs(_with_hubs(shared, hubs, "p"), hubs, "q").withColumn(
        "via", F.array_intersect("hubs_p", "hubs_q")).withColumn("codegree", F.col("shared") + F.size("via")), "met")
    key = [GRAPH, "c", "p", "q"]
    others = F.col("codegree") - 1
    is_open = (F.coalesce("closed", F.lit(0)) == 0) & (others > F.coalesce("common", F.lit(0)))
    seen = (
        wedges.join(met.filter("codegree > 1").select(GRAPH, "p", "q", "codegree"), [GRAPH, "p", "q"])
        .join(chords, key, "left")
        .select(GRAPH, F.inline(F.array(_seen_from("c", "p", others, is_open), _seen_from("c", "q", others, is_open))))
    )
    return seen.unionByName(_seen_at_heavy(met, chords, hubs)).unionByName(
        _seen_by_class(heavy, hubs)).unionByName(_seen_twice(corner, hubs))


def _with_hubs(rows: DataFrame, hubs: DataFrame, node: str) -> DataFrame:
    """Adds ``hubs_<node>``, empty for a node without heavy neighbours."""
    named = hubs.select(GRAPH, F.col("node").alias(node), F.col("hubs").alias(f"hubs_{node}"))
    return rows.join(named, [GRAPH, node], "left").withColumn(
        f"hubs_{node}", F.coalesce(f"hubs_{node}", F.array().cast("array<bigint>")))


def _beyond(hubs: str, center: str) -> Column:
    """Heavy neighbours in ``hubs`` that are not the heavy center and do not touch it."""
    return F.array_except(F.array_except(hubs, f"hubs_{center}"), F.array(center))


def _seen_at_heavy(met: DataFrame, chords: DataFrame, hubs: DataFrame) -> DataFrame:
    """What pairs that meet at light nodes add to their edges at a heavy c.

    A node is open here if a light node closes a cycle without chord and no heavy one does, as the
    latter is counted by classes.
    """
    rows = met.filter(F.size("via") > 0).select(GRAPH, "p", "q", "shared", "codegree", "hubs_p", "hubs_q", F.explode("via").alias("c"))
    rows = _with_hubs(rows, hubs, "c").join(chords, [GRAPH, "c", "p", "q"], "left")
    light = (F.coalesce("closed", F.lit(0)) == 0) & (F.col("shared") > F.coalesce("common", F.lit(0)))
    others = F.col("codegree") - 1
    return rows.select(GRAPH, F.inline(F.array(
        _seen_from("c", "p", others, light & ~F.arrays_overlap("hubs_q", _beyond("hubs_p", "c"))),
        _seen_from("c", "q", others, light & ~F.arrays_overlap("hubs_p", _beyond("hubs_q", "c"))),
    )))


def _seen_by_class(heavy: DataFrame, hubs: DataFrame) -> DataFrame:
    """What the classes of nodes with equal heavy neighbours add to the edges of each heavy c.

    For a heavy c and a class of its neighbours, every other class that shares a second hub is met
    once: it adds its size if one of the shared hubs is beyond c, and its overlap to the largest.
    """
    classes = stage(hubs.groupBy(GRAPH, "hubs").agg(F.count("*").alias("size")).withColumn("class", F.monotonically_increasing_id()), "classes")
    around = classes.select(GRAPH, "class", "hubs", "size", F.explode("hubs").alias("c"))
    pairs = around.select(GRAPH, "class", "hubs", "size", "c", F.explode("hubs").alias("w")).filter("c <> w")
    mine = pairs.select(GRAPH, "c", "w", F.col("class").alias("own"))
    meetings = mine.join(pairs.select(GRAPH, "c", "w", F.col("class").alias("other")), [GRAPH, "c", "w"]).select(GRAPH, "c", "own", "other").distinct()
    named = classes.select(GRAPH, "class", "hubs", "size")
    rows = meetings.join(named.withColumnsRenamed({"class": "own", "hubs": "hubs_own", "size": "n_own"}), [GRAPH, "own"])
    rows = rows.join(named.withColumnsRenamed({"class": "other", "hubs": "hubs_other", "size": "n_other"}), [GRAPH, "other"])
    rows = _with_hubs(rows, hubs, "c")
    closes = F.arrays_overlap("hubs_other", _beyond("hubs_own", "c"))
    alone = (F.col("own") == F.col("other")) & (F.col("n_own") == 1)
    added = rows.groupBy(GRAPH, "c", "own").agg(
        # The node itself is in its own class.
        F.sum(F.when(closes, F.col("n_other") - (F.col("own") == F.col("other")).cast("long")).otherwise(0)).alias("open"),
        F.max(F.when(alone, 0).otherwise(F.size(F.array_intersect("hubs_own", "hubs_other")) - 1)).alias("through"),
    )
    members = hubs.join(classes.select(GRAPH, "hubs", F.col("class").alias("own")), [GRAPH, "hubs"]).select(GRAPH, "node", "own")
    arcs = heavy.withColumnRenamed("hub", "c").join(members, [GRAPH, "node"])
    return arcs.join(added, [GRAPH, "c", "own"]).select(GRAPH, *_edge_of("c", "node"), F.col("through").cast("long").alias("through"), F.col("open").cast("long").alias("open"))


def _seen_twice(corner: DataFrame, hubs: DataFrame) -> DataFrame:
    """Takes back common neighbours of an edge at a heavy c that the classes have counted."""
    centers = hubs.select(GRAPH, F.explode("hubs").alias("c")).distinct()
    rows = corner.join(centers, [GRAPH, "c"], "left_semi")
    for node in ("c", "p", "q"):
        rows = _with_hubs(rows, hubs, node)
    none = F.lit(0)
    return rows.select(GRAPH, F.inline(F.array(
        _seen_from("c", "p", none, -F.arrays_overlap("hubs_q", _beyond("hubs_p", "c")).cast("long")),
        _seen_from("c", "q", none, -F.arrays_overlap("hubs_p", _beyond("hubs_q", "c")).cast("long")),
    )))


def tiles(degree: str, tile: int) -> Column:
    return (F.floor(F.col(degree) / tile) + 1).cast("int")


def all_of(count: Column) -> Column:
    """A row for each number below ``count``."""
    return F.explode(F.sequence(F.lit(0), count - 1))


def edge_neighbors(degreed: DataFrame, end: str, tile: int = TILE, edges: DataFrame | None = None) -> DataFrame:
    """``(graph_id, u, v, deg_u, deg_v, node)``: neighbours of one end of each edge, or of each of ``edges``.

    A node of many edges meets its arcs in tiles: both are dealt over parts of its degree and every part
    of the one meets every part of the other under a key of its own.
    """
    parts = tiles(f"deg_{end}", tile)
    mine = (degreed if edges is None else edges).select(*EDGE_KEY, "deg_u", "deg_v").withColumn("edge_part", F.pmod(F.xxhash64("u", "v"), parts).cast("int")).withColumn("arc_part", all_of(parts))
    arcs = arcs_with_degree(degreed).select(
        GRAPH, F.col("s").alias(end), F.col("d").alias("node"),
        F.pmod(F.xxhash64("d"), tiles("deg_s", tile)).cast("int").alias("arc_part"), all_of(tiles("deg_s", tile)).alias("edge_part"))
    return mine.join(arcs, [GRAPH, end, "edge_part", "arc_part"]).select(*EDGE_KEY, "deg_u", "deg_v", "node")


def exclusive_neighbors(degreed: DataFrame, tile: int = TILE, block: int = blocks.BLOCK) -> DataFrame:
    """``(graph_id, u, v, side, node)``: neighbours of one end only, the other end excluded.

    ``side`` is ``"u"`` or ``"v"``. Rows number the sum of both degrees over all edges. They are made in blocks
    of the ends they do not touch; those that do not touch an end with more than ``block`` paths by joins, those of a hub's
    edges by many tasks.
    """
    all_arcs = arcs_with_degree(degreed).select(GRAPH, "s", "d", F.col("deg_d").cast("double").alias("load"))
    lists = blocks.packed_lists(all_arcs)
    own, large, count = blocks.in_blocks(lists, block)
    found = blocks.far_neighbors(lists, own, count, block).select(
        *EDGE_KEY, F.when(F.col("far_u"), "u").otherwise("v").alias("side"), F.explode("nodes").alias("node"))
    if large.isEmpty():
        return found
    arcs = arcs_with_degree(degreed).select(GRAPH, "s", "d")

    def one_side(near: str, far: str) -> DataFrame:
        other = arcs.select(GRAPH, F.col("s").alias(far), F.col("d").alias("node"))
        edges = degreed.join(large.select(GRAPH, F.col("node").alias(far)), [GRAPH, far], "left_semi")
        return (
            edge_neighbors(degreed, near, tile, edges)
            .filter(F.col("node") != F.col(far))
            .join(other, [GRAPH, far, "node"], "left_anti")
            .select(*EDGE_KEY, F.lit(near).alias("side"), "node")
        )

    return found.unionByName(one_side("u", "v")).unionByName(one_side("v", "u"))


def local_structure(degreed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """Degrees, triangles, ``n_quad``, ``codeg_max`` and ``quad_cap`` of every edge.

    In graphs without heavy nodes one walk over the paths of two arcs counts all of them.
    """
    light, hubby = _by_hubs(degreed, heavy_degree)
    found = _structure_in_blocks(light)
    if hubby is not None:
        found = found.unionByName(_structure_by_joins(hubby, heavy_degree))
    return found.withColumn("quad_cap", F.col("codeg_max") * F.greatest("deg_u", "deg_v"))


def _structure_in_blocks(degreed: DataFrame) -> DataFrame:
    names = {"deg_u": "deg_u", "deg_v": "deg_v", "both": "n_tri", "open": "n_quad", "through": "codeg_max"}
    return _seen_in_blocks(degreed, [*names]).select(*EDGE_KEY, *[F.col(c).alias(name) for c, name in names.items()])


def _structure_by_joins(degreed: DataFrame, heavy_degree: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    return (
        degreed.join(triangles_per_edge(degreed), EDGE_KEY, "left")
        .join(quad_counts(degreed, heavy_degree), EDGE_KEY, "left")
        .select(*EDGE_KEY, "deg_u", "deg_v", *[F.coalesce(c, zero).alias(c) for c in ("n_tri", "n_quad", "codeg_max")])
    )
