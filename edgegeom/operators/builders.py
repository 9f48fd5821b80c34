"""Edge tables of regular and random graph families.

Builders take node tables ``(graph_id, id, ...)`` with ids ``0 .. n-1`` in each graph, so they work
on ``spark.range`` as well as on ids taken from a table, and many graphs are built in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..columns import EDGE_KEY, GRAPH
from ..functions.draws import uniform
from ..staging import stage
from .clean import canonical_edges


def node_table(spark: SparkSession, graph_id: str, n: int) -> DataFrame:
    """Nodes ``0 .. n-1`` of one graph, with ``n`` on every row."""
    return spark.range(n).select(F.lit(graph_id).alias(GRAPH), "id", F.lit(n).cast("long").alias("n"))


def _link(nodes: DataFrame, *targets: Column) -> DataFrame:
    """Edges from each node to the given target ids; null targets are dropped."""
    arcs = nodes.select(
        GRAPH, F.col("id").alias("src"), F.explode(F.array_compact(F.array(*targets))).alias("dst")
    )
    return canonical_edges(arcs).select(*EDGE_KEY)


def cycle_edges(nodes: DataFrame) -> DataFrame:
    """A ring over all nodes; needs column ``n``."""
    return _link(nodes, (F.col("id") + 1) % F.col("n"))


def _grid_position(rows, cols) -> tuple[Column, Column, Column, Column]:
    rows = rows if isinstance(rows, Column) else F.lit(rows).cast("long")
    cols = cols if isinstance(cols, Column) else F.lit(cols).cast("long")
    return rows, cols, F.floor(F.col("id") / cols), F.col("id") % cols


def grid_edges(nodes: DataFrame, rows, cols) -> DataFrame:
    """A rows x cols grid with id = row * cols + column; links to ids that are no node are left out."""
    rows, cols, row, col = _grid_position(rows, cols)
    inside = nodes.filter(row < rows)
    return _link(
        inside,
        F.when(col + 1 < cols, F.col("id") + 1),
        F.when(row + 1 < rows, F.col("id") + cols),
    )


def torus_edges(nodes: DataFrame, rows, cols) -> DataFrame:
    """A grid whose last row and column meet the first; sides of 1 or 2 collapse."""
    rows, cols, row, col = _grid_position(rows, cols)
    inside = nodes.filter(row < rows)
    return _link(inside, row * cols + (col + 1) % cols, ((row + 1) % rows) * cols + col)


def tree_size(d: int, h: int) -> int:
    """Nodes of the complete d-ary tree of height h."""
    if h < 0:
        return 0
    if d < 1:
        return 1
    return h + 1 if d == 1 else (d ** (h + 1) - 1) // (d - 1)


def tree_edges(nodes: DataFrame, d: int) -> DataFrame:
    """The first nodes of the d-ary tree in level order; every node but 0 links to its parent."""
    if d < 1:
        return nodes.limit(0).select(GRAPH, F.col("id").alias("u"), F.col("id").alias("v"))
    return _link(nodes.filter(F.col("id") >= 1), F.floor((F.col("id") - 1) / d))


def complete_edges(nodes: DataFrame) -> DataFrame:
    """Every pair of nodes of a graph; needs column ``n``. The pairs are the result itself."""
    return nodes.filter(F.col("id") + 1 < F.col("n")).select(
        GRAPH, F.col("id").alias("u"),
        F.explode(F.sequence(F.col("id") + 1, F.col("n") - 1)).alias("v"),
    )


def bernoulli_ranges(ranges: DataFrame, seed: int, max_id: int) -> DataFrame:
    """Keep each pair ``(a, b)`` with ``lo <= b < hi`` independently with probability ``p``.

    ``ranges`` is ``(graph_id, a, lo, hi, p)`` with ``hi <= max_id + 1``. The ids are halved again
    and again: a block known to hold a kept id is split into left, right or both by one draw with
    the exact conditional odds. Empty blocks stop at once, so the work grows with the kept pairs
    and not with all pairs, and there is no shuffle. The ranges of one ``a`` must not overlap; the
    result is ``(graph_id, a, b, p)``.
    """
    levels = max(1, math.ceil(math.log2(max_id + 1)))
    drop = F.log(F.lit(1.0) - F.col("p"))

    def empty(count: Column) -> Column:
        """Chance that none of ``count`` ids is kept."""
        return F.when(count <= 0, F.lit(1.0)).when(F.col("p") >= 1, F.lit(0.0)).otherwise(
            F.exp(count * drop))

    def draw(level: int) -> Column:
        return uniform(seed, F.col(GRAPH), F.col("a"), F.col("lo"), F.lit(level), F.col("at"))

    # ``at`` counts from ``lo``, so a short range passes the wide levels without a draw. Rows grow
    # from here on without another shuffle, so they are spread first.
    blocks = (
        ranges.filter((F.col("p") > 0) & (F.col("hi") > F.col("lo")))
        .repartition(GRAPH, "a", "lo")
        .withColumn("size", F.col("hi") - F.col("lo"))
        .withColumn("at", F.lit(0).cast("long"))
        .filter(draw(levels) < F.lit(1.0) - empty(F.col("size")))
    )
    for level in range(levels - 1, -1, -1):
        width = 1 << level
        rest = F.col("size") - F.col("at")
        none_left = empty(F.least(rest, F.lit(width)))
        none_right = empty(F.least(rest - width, F.lit(width)))
        u = draw(level) * (F.lit(1.0) - none_left * none_right)
        left_only = (F.lit(1.0) - none_left) * none_right
        right_only = none_left * (F.lit(1.0) - none_right)
        left = F.array(F.col("at"))
        right = F.array(F.col("at") + width)
        chosen = (
            F.when(rest <= width, left)
            .when(u < left_only, left)
            .when(u < left_only + right_only, right)
            .otherwise(F.concat(left, right))
        )
        blocks = blocks.select(GRAPH, "a", "lo", "size", "p", F.explode(chosen).alias("at"))
    return blocks.select(GRAPH, "a", (F.col("lo") + F.col("at")).alias("b"), "p")


def bernoulli_edges(nodes: DataFrame, p: float, seed: int, max_id: int) -> DataFrame:
    """Each pair of nodes with probability ``p``; needs column ``n``."""
    ranges = nodes.select(
        GRAPH, F.col("id").alias("a"), (F.col("id") + 1).alias("lo"), F.col("n").alias("hi"),
        F.lit(float(p)).alias("p"),
    )
    return bernoulli_ranges(ranges, seed, max_id).select(
        GRAPH, F.col("a").alias("u"), F.col("b").alias("v")
    )


def check_block_odds(odds: list[list[float]]) -> None:
    """Reject a probability matrix that is not square, symmetric and within [0, 1]."""
    k = len(odds)
    if any(len(row) != k for row in odds):
        raise ValueError("block probabilities must form a square matrix")
    for i in range(k):
        for j in range(k):
            if not 0.0 <= odds[i][j] <= 1.0:
                raise ValueError("block probabilities must lie in [0, 1]")
            if odds[i][j] != odds[j][i]:
                raise ValueError("block probabilities must be symmetric")


def block_edges(
    nodes: DataFrame, sizes: list[int], odds: list[list[float]], seed: int
) -> DataFrame:
    """Pairs with a probability per pair of blocks; blocks are consecutive id ranges of ``sizes``."""
    check_block_odds(odds)
    if len(sizes) != len(odds) or any(s <= 0 for s in sizes):
        raise ValueError("block sizes must be positive and match the probabilities")
    starts = [sum(sizes[:i]) for i in range(len(sizes) + 1)]

    def long(x: int) -> Column:
        return F.lit(x).cast("long")

    def reach(i: int) -> Column:
        """Candidate ranges of a node of block i: its own block and the later ones."""
        return F.array(*[
            F.struct(F.greatest(long(starts[j]), F.col("id") + 1).alias("lo"),
                     long(starts[j + 1]).alias("hi"), F.lit(float(odds[i][j])).alias("p"))
            for j in range(i, len(sizes))
        ])

    own = reach(len(sizes) - 1)
    for i in range(len(sizes) - 2, -1, -1):
        own = F.when(F.col("id") < starts[i + 1], reach(i)).otherwise(own)
    ranges = nodes.filter(F.col("id") < starts[-1]).select(
        GRAPH, F.col("id").alias("a"), F.inline(own)
    )
    return bernoulli_ranges(ranges, seed, starts[-1] - 1).select(
        GRAPH, F.col("a").alias("u"), F.col("b").alias("v")
    )


def two_level_block_edges(
    nodes: DataFrame, sizes: list[int], p_in: float, p_out: float, seed: int
) -> DataFrame:
    """Block graph with one probability inside blocks and one across."""
    odds = [[p_in if i == j else p_out for j in range(len(sizes))] for i in range(len(sizes))]
    return block_edges(nodes, sizes, odds, seed)


def halves(n: int) -> list[int]:
    """Two blocks of n nodes, the first one rounded down."""
    return [n // 2, n - n // 2]


def uniform_points(nodes: DataFrame, seed: int) -> DataFrame:
    """Nodes with a uniform position ``(x, y)`` in the unit square."""
    return nodes.withColumn("x", uniform(seed, F.lit("x"), F.col(GRAPH), F.col("id"))).withColumn(
        "y", uniform(seed, F.lit("y"), F.col(GRAPH), F.col("id"))
    )


def radius_edges(points: DataFrame, radius: Column) -> DataFrame:
    """Pairs of points closer than ``radius`` (strictly), one radius per graph.

    Points fall into square cells of the radius. One side is copied to the half of the
    neighbouring cells that comes later in order, so each pair of cells meets once.
    """
    cells = points.select(
        GRAPH, "id", "x", "y", radius.alias("r"),
        F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"),
    )
    ahead = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
    shifts = F.array(*[
        F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"),
                 F.lit(dx == 0 and dy == 0).alias("same"))
        for dx, dy in ahead
    ])
    left = cells.select(GRAPH, F.col("id").alias("a"), F.col("x").alias("ax"),
                        F.col("y").alias("ay"), "r", F.inline(shifts))
    right = cells.select(GRAPH, F.col("id").alias("b"), F.col("x").alias("bx"),
                         F.col("y").alias("by"), "cx", "cy")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return (
        left.join(right, [GRAPH, "cx", "cy"])
        .filter((~F.col("same") | (F.col("a") < F.col("b")))
                & (dx * dx + dy * dy < F.col("r") * F.col("r")))
        .select(GRAPH, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    )


def hyperbolic_points(nodes: DataFrame, radius: float, alpha: float, seed: int) -> DataFrame:
    """Nodes with an angle ``theta`` and ``c = cosh(alpha r)``, ``s = sinh(alpha r)``.

    The angle is uniform and ``c`` is uniform on ``[1, cosh(alpha * radius)]``.
    """
    edge = math.cosh(alpha * radius)
    at = [F.col(GRAPH), F.col("id")]
    return (
        nodes.withColumn("theta", uniform(seed, F.lit("t"), *at) * (2.0 * math.pi))
        .withColumn("c", F.lit(1.0) + uniform(seed, F.lit("r"), *at) * (edge - 1.0))
        .withColumn("s", F.sqrt(F.col("c") * F.col("c") - 1.0))
    )


def hyperbolic_edges(points: DataFrame, radius: float, alpha: float) -> DataFrame:
    """Pairs of points at hyperbolic distance at most ``radius``.

    Points fall into rings of equal width; each ring is cut into sectors about as wide as the
    largest angle at which two of its points can still be linked. A point looks only outwards,
    at the sectors its own largest angle covers in each ring, so pairs meet on equal keys and the
    exact test ``cosh(alpha d) <= cosh(alpha radius)`` decides.
    """
    limit = math.cosh(alpha * radius)
    rings = max(1, math.ceil(alpha * radius))
    turn = 2.0 * math.pi

    def widest(c: float, s: float) -> float:
        if s <= 0.0:
            return math.pi
        return math.acos(max(-1.0, min(1.0, (c * c - limit) / (s * s))))

    inner = [(math.cosh(k), math.sinh(k)) for k in range(rings)]
    sectors = [max(1, int(turn / max(widest(c, s), 1e-12))) for c, s in inner]
    ring_table = F.array(*[
        F.struct(F.lit(k).alias("ring"), F.lit(c).alias("rc"), F.lit(s).alias("rs"),
                 F.lit(n).cast("long").alias("n_sec"))
        for k, ((c, s), n) in enumerate(zip(inner, sectors))
    ])
    ring = F.least(F.floor(F.acosh(F.greatest(F.lit(1.0), F.col("c")))), F.lit(rings - 1)).cast("int")
    own = points.select(GRAPH, "id", "theta", "c", "s", ring.alias("own_ring"))

    cosine = F.try_divide(F.col("c") * F.col("rc") - limit, F.col("s") * F.col("rs"))
    half = F.when(cosine.isNull(), F.lit(math.pi)).otherwise(
        F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) + 1e-9)
    step = F.lit(turn) / F.col("n_sec")
    first = F.floor((F.col("theta") - F.col("half")) / step)
    last = F.floor((F.col("theta") + F.col("half")) / step)
    seen = F.when(last - first + 1 >= F.col("n_sec"), F.sequence(F.lit(0).cast("long"), F.col("n_sec") - 1)
                  ).otherwise(F.transform(F.sequence(first, last), lambda k: F.pmod(k, F.col("n_sec"))))
    left = (
        own.withColumn("view", F.filter(ring_table, lambda r: r["ring"] >= F.col("own_ring")))
        .select(GRAPH, F.col("id").alias("a"), "theta", "c", "s", "own_ring", F.inline("view"))
        .withColumn("half", half)
        .select(GRAPH, "a", F.col("theta").alias("at"), F.col("c").alias("ac"),
                F.col("s").alias("as"), "own_ring", "ring", F.explode(seen).alias("sector"))
    )
    n_own = F.element_at(ring_table, F.col("own_ring") + 1)["n_sec"]
    right = own.select(
        GRAPH, F.col("id").alias("b"), F.col("theta").alias("bt"), F.col("c").alias("bc"),
        F.col("s").alias("bs"), F.col("own_ring").alias("ring"),
        F.pmod(F.floor(F.col("theta") / (F.lit(turn) / n_own)), n_own).alias("sector"),
    )
    spread = F.col("ac") * F.col("bc") - F.col("as") * F.col("bs") * F.cos(F.col("at") - F.col("bt"))
    return (
        left.join(right, [GRAPH, "ring", "sector"])
        .filter(((F.col("ring") > F.col("own_ring")) | (F.col("a") < F.col("b")))
                & (spread <= limit))
        .select(GRAPH, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    )


def soft_hyperbolic_edges(
    points: DataFrame, radius: float, alpha: float, temperature: float, seed: int
) -> DataFrame:
    """Pairs of points, each kept with probability ``1 / (1 + exp((d - radius) / (2 T)))``.

    Every pair has a chance, but far pairs a tiny one. The points of a ring lie in narrow sectors
    with numbered slots. Seen from a point, the sectors of each ring outwards form blocks that
    double in width with the angle; a block is searched with the largest odds any of its points can
    have (``bernoulli_ranges`` skips what it does not keep), and a found point is accepted with its
    own odds over these. Each pair lies in one block of its inner point, so the result has exactly
    the wanted odds while the work grows with the links and not with all pairs.
    """
    if temperature <= 0:
        return hyperbolic_edges(points, radius, alpha)
    limit, turn = math.cosh(alpha * radius), 2.0 * math.pi
    rings = max(1, math.ceil(alpha * radius))
    n = points.count()
    # Odd numbers of sectors, about four points each: no two sectors are exactly opposite.
    expected = [n * (math.cosh(k + 1) - math.cosh(k)) / (limit - 1.0) for k in range(rings)]
    sectors = [2 * int(min(x, n) / 8) + 1 for x in expected]
    sector_of = F.element_at(F.array(*[F.lit(x).cast("long") for x in sectors]), F.col("ring") + 1)
    placed = (
        points.withColumn("ring", F.least(
            F.floor(F.acosh(F.greatest(F.lit(1.0), F.col("c")))), F.lit(rings - 1)).cast("int"))
        .withColumn("sector", F.least(sector_of - 1, F.floor(F.col("theta") / (F.lit(turn) / sector_of))))
    )
    in_sector = Window.partitionBy(GRAPH, "ring", "sector").orderBy("id")
    placed = stage(
        placed.withColumn("slot", F.row_number().over(in_sector) - 1)
        .select(GRAPH, "id", "theta", "c", "s", "ring", "sector", "slot")
        .repartition(GRAPH, "id"),
        "hyperbolic",
    )
    # One row per ring comes to the driver: the slots each ring needs per sector.
    depth = {r.ring: r.slots for r in placed.groupBy("ring").agg((F.max("slot") + 1).alias("slots")).collect()}
    slots = [depth.get(k, 0) for k in range(rings)]
    starts = [sum(sectors[i] * slots[i] for i in range(k)) for k in range(rings + 1)]
    layout = F.array(*[
        F.struct(F.lit(k).alias("out"), F.lit(sectors[k]).cast("long").alias("n_sec"),
                 F.lit(slots[k]).cast("long").alias("depth"), F.lit(starts[k]).cast("long").alias("start"))
        for k in range(rings) if slots[k]
    ])
    views = placed.select(
        GRAPH, "id", "theta", "c", "s", "ring", "sector",
        F.inline(F.filter(layout, lambda r: r["out"] >= F.col("ring"))),
    ).withColumn("width", F.lit(turn) / F.col("n_sec")).withColumn(
        "home", F.least(F.col("n_sec") - 1, F.floor(F.col("theta") / F.col("width"))))
    # Offsets 0, 1, 2-3, 4-7, .. up to half a turn, on both sides of another ring.
    half = F.floor((F.col("n_sec") - 1) / 2)
    doublings = F.when(half >= 1, F.sequence(F.lit(0), F.floor(F.log2(half.cast("double"))).cast("int"))
                       ).otherwise(F.array().cast("array<int>"))

    def block(side: int):
        def make(m: Column) -> Column:
            near = F.pow(F.lit(2.0), m).cast("long")
            far = F.least(near * 2 - 1, half)
            first, last = (near, far) if side > 0 else (-far, -near)
            return F.struct((F.col("home") + first).alias("first"), (F.col("home") + last).alias("last"),
                            ((near - 1) * F.col("width")).alias("apart"))
        return make

    own = F.array(F.struct(F.col("home").alias("first"), F.col("home").alias("last"), F.lit(0.0).alias("apart")))
    ahead = F.transform(doublings, block(1))
    behind = F.when(F.col("out") > F.col("ring"), F.transform(doublings, block(-1))).otherwise(
        F.filter(ahead, lambda b: F.lit(False)))
    blocks = views.select(GRAPH, "id", "c", "s", "out", "n_sec", "depth", "start",
                          F.inline(F.concat(own, ahead, behind)))

    def odds(spread: Column) -> Column:
        d = F.acosh(F.greatest(F.lit(1.0), spread)) / alpha
        return F.lit(1.0) / (F.lit(1.0) + F.exp((d - radius) / (2.0 * temperature)))

    cosine = F.cos(F.least(F.lit(math.pi), F.col("apart")))
    closest = F.greatest(F.col("out").cast("double"), F.least(
        F.col("out") + 1.0, F.atanh(F.least(F.lit(1.0 - 1e-15), F.col("s") / F.col("c") * cosine))))
    best = odds((F.col("c") * F.cosh(closest) - F.col("s") * F.sinh(closest) * cosine) * (1.0 - 1e-12))

    def cut(first: Column, last: Column) -> Column:
        return F.struct((F.col("start") + first * F.col("depth")).alias("lo"),
                        (F.col("start") + (last + 1) * F.col("depth")).alias("hi"))

    top, zero = F.col("n_sec") - 1, F.lit(0).cast("long")
    pieces = F.array(
        cut(F.greatest(zero, F.col("first")), F.least(top, F.col("last"))),
        cut(F.col("first") + F.col("n_sec"), F.least(top, F.col("last") + F.col("n_sec"))),
        cut(F.greatest(zero, F.col("first") - F.col("n_sec")), F.col("last") - F.col("n_sec")),
    )
    inside = [
        F.least(top, F.col("last")) >= F.greatest(zero, F.col("first")),
        F.col("first") < 0,
        F.col("last") > top,
    ]
    pieces = F.array_compact(F.array(*[F.when(keep, pieces[k]) for k, keep in enumerate(inside)]))
    ranges = blocks.select(GRAPH, F.col("id").alias("a"), best.alias("p"), F.inline(pieces))
    found = bernoulli_ranges(ranges, seed, max(1, starts[-1] - 1)).withColumnRenamed("b", "at")

    def ends(mark: str) -> DataFrame:
        return placed.select(GRAPH, F.col("id").alias(mark), *[
            F.col(c).alias(f"{mark}_{c}") for c in ("theta", "c", "s", "ring", "sector")])

    slot_start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("ring") + 1)
    slot_depth = F.element_at(F.array(*[F.lit(x).cast("long") for x in slots]), F.col("ring") + 1)
    by_slot = placed.select(GRAPH, (slot_start + F.col("sector") * slot_depth + F.col("slot")).alias("at"),
                            F.col("id").alias("b"))
    pairs = found.join(by_slot, [GRAPH, "at"]).join(ends("a"), [GRAPH, "a"]).join(ends("b"), [GRAPH, "b"])
    twice = (F.col("a_ring") == F.col("b_ring")) & (F.col("a_sector") == F.col("b_sector"))
    spread = F.col("a_c") * F.col("b_c") - F.col("a_s") * F.col("b_s") * F.cos(F.col("a_theta") - F.col("b_theta"))
    draw = uniform(seed, F.lit("keep"), F.col(GRAPH), F.col("a"), F.col("b"))
    return (
        pairs.filter(~twice | (F.col("a") < F.col("b")))
        .filter(draw * F.col("p") < odds(spread))
        .select(GRAPH, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    )
