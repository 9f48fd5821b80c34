"""Edge cleaning, adjacency, arc values and bounded distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import EDGE_KEY, GRAPH
from ..staging import scratch, stage, stage_at, staging_path
from . import blocks

ARC_AGGREGATES = {
    "mean": lambda value, pos: F.avg(value),
    "sum": lambda value, pos: F.sum(value),
    "min": lambda value, pos: F.min(value),
    "max": lambda value, pos: F.max(value),
    "first": lambda value, pos: F.min_by(value, pos),
}


def canonical_edges(arcs: DataFrame) -> DataFrame:
    """Drop loops, order endpoints and keep each undirected edge once."""
    return (
        arcs.filter(F.col("src") != F.col("dst"))
        .select(GRAPH, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .distinct()
    )


def pairs_to_arcs(pairs: DataFrame) -> DataFrame:
    """Both directions of a table of pairs ``(graph_id, u, v)``."""
    return pairs.select(GRAPH, F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(
        pairs.select(GRAPH, F.col("v").alias("src"), F.col("u").alias("dst"))
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """Long adjacency ``(graph_id, s, d)``: every edge once from each end."""
    ends = F.array(
        F.struct(F.col("u").alias("s"), F.col("v").alias("d")),
        F.struct(F.col("v").alias("s"), F.col("u").alias("d")),
    )
    return edges.select(GRAPH, F.inline(ends))


def degrees(edges: DataFrame) -> DataFrame:
    """``(graph_id, s, k)``; the count is combined before the shuffle, so hubs stay cheap.

    Joins take the order of their keys from the one they are grouped by, so the node comes first here too.
    """
    return adjacency(edges).groupBy("s", GRAPH).agg(F.count("*").alias("k")).select(GRAPH, "s", "k")


def neighbor_lists(edges: DataFrame) -> DataFrame:
    """Sorted neighbour arrays ``(graph_id, s, ns)``."""
    return adjacency(edges).groupBy(GRAPH, "s").agg(F.sort_array(F.collect_set("d")).alias("ns"))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node of a node table ``(graph_id, s)``; isolated nodes get 0."""
    return nodes.join(degrees(edges), [GRAPH, "s"], "left").select(
        GRAPH, "s", F.coalesce("k", F.lit(0)).cast("long").alias("k")
    )


def node_count(edges: DataFrame) -> DataFrame:
    """``n = 1 + largest id`` per graph."""
    return edges.groupBy(GRAPH).agg((F.max(F.greatest("u", "v")) + 1).alias("n"))


#: A node holding more than one in this many edge ends is looked up by broadcast.
HOT_SHARE = 1000
#: Keys over which the edges of such nodes are spread in the remaining lookup.
HOT_SPREAD = 1024
#: Edges of one node that a single task takes without further care.
ARCS_PER_KEY = 1 << 16
#: Edges of one node that may lie in one part of a prepared table.
EVEN = 1 << 12
#: Degrees that may be broadcast: files tell little of their size in memory.
BROADCAST_NODES = 1 << 18


def _attach_degree(rows: DataFrame, deg: DataFrame, end: str, limit: float | None) -> DataFrame:
    """Add ``deg_<end>``; nodes above ``limit`` are served by broadcast.

    All other edges meet their node's row by key, while the edges already served spread over
    unused keys, so no task receives all edges of a hub. The node comes first in the keys: joins sort by them in
    turn, and names that many rows share tell few of them apart.
    """
    named = deg.select(GRAPH, F.col("s").alias(end), F.col("k").alias(f"deg_{end}"))
    if limit is None:
        return rows.join(named, [end, GRAPH])
    hot = deg.filter(F.col("k") > limit).select(GRAPH, F.col("s").alias(end), F.col("k").alias("hot_k"))
    served = F.when(F.col("hot_k").isNull(), 0).otherwise(
        F.pmod(F.xxhash64("u", "v"), F.lit(HOT_SPREAD)).cast("int") + 1)
    return (
        rows.join(F.broadcast(hot), [GRAPH, end], "left")
        .withColumn("spread", served)
        .join(named.withColumn("spread", F.lit(0)), [end, GRAPH, "spread"], "left")
        .withColumn(f"deg_{end}", F.coalesce("hot_k", f"deg_{end}"))
        .drop("hot_k", "spread")
    )


def with_degrees(edges: DataFrame, arcs_per_key: int = ARCS_PER_KEY) -> DataFrame:
    """Edges with the degrees of both ends.

    Where some node has more than ``arcs_per_key`` edges, the nodes holding more than one in
    ``HOT_SHARE`` of all edge ends are broadcast: at most ``HOT_SHARE`` rows for any graph.
    """
    return _with_degrees(edges, arcs_per_key)[0]


def _with_degrees(edges: DataFrame, arcs_per_key: int = ARCS_PER_KEY) -> tuple[DataFrame, int]:
    """The same and the largest degree; degrees are staged, so their shuffle does not lie beside those of the edges."""
    deg = stage(degrees(edges), "degrees")
    ends, most, nodes = deg.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0)), F.count("*")).first()
    limit = max(arcs_per_key, ends / HOT_SHARE)
    rows = edges.select(*EDGE_KEY)
    if nodes > BROADCAST_NODES:
        deg = deg.hint("merge")
    for end in ("u", "v"):
        rows = _attach_degree(rows, deg, end, limit if most > limit else None)
    return rows.select(*EDGE_KEY, "deg_u", "deg_v"), most


def prepare(edges: DataFrame) -> DataFrame:
    """Edges with degrees, written once and spread evenly.

    Every later step starts from this table. Joins with the degrees leave the edges of a node together. Where a node
    has more than ``EVEN``, rows are spread by the whole edge key, so the edges of a hub lie in all partitions; later
    steps expand rows, so small partitions pay off.
    """
    path = staging_path(edges.sparkSession, "degreed")
    with scratch(edges.sparkSession):
        rows, most = _with_degrees(stage(edges.select(*EDGE_KEY), "edges"))
        return stage_at(rows.repartition(*EDGE_KEY) if most > EVEN else rows, path)


def arc_values_to_edges(edges: DataFrame, arc_values: DataFrame, agg: str = "mean") -> DataFrame:
    """One value per edge from values on arcs ``(graph_id, pos, src, dst, value)``.

    Loops are skipped; an edge without values gets NaN; ``first`` takes the lowest ``pos``.
    """
    if agg not in ARC_AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; use one of {sorted(ARC_AGGREGATES)}")
    per_edge = (
        arc_values.filter(F.col("src") != F.col("dst"))
        .groupBy(GRAPH, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .agg(ARC_AGGREGATES[agg](F.col("value"), F.col("pos")).alias("value"))
    )
    return edges.select(*EDGE_KEY).join(per_edge, EDGE_KEY, "left").withColumn(
        "value", F.coalesce("value", F.lit(float("nan")))
    )


def edgewise(edges: DataFrame, x: float | DataFrame, name: str) -> DataFrame:
    """Attach a threshold column: one number for all edges, or a table ``(graph_id, u, v, x)``.

    A table must cover every edge; a missing row fails the job instead of turning into a null.
    """
    if isinstance(x, DataFrame):
        given = x.select(*EDGE_KEY, F.col("x").cast("double").alias(name))
        joined = edges.join(given, EDGE_KEY, "left")
        missing = F.raise_error(F.lit(f"{name} has no value for some edge")).cast("double")
        return joined.withColumn(name, F.coalesce(name, missing))
    return edges.withColumn(name, F.lit(float(x)))


#: Sources that share one word of a frontier row.
WORD = 64


def _word(node: Column) -> list[Column]:
    """The block of a source and its bit in the block's words."""
    bit = node.bitwiseAND(F.lit(WORD - 1)).cast("int")
    return [F.shiftright(node, 6).alias("block"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mask")]


def bit_frontiers(edges: DataFrame, sources: DataFrame, max_depth: int) -> list[DataFrame]:
    """Per depth from 0 on ``(graph_id, block, node, mask)``: which sources of a block first reach a node there.

    A row stands for up to ``WORD`` sources with neighbouring ids: their walks are one walk whose words are
    combined by ``bit_or`` before and after the shuffle. A node at depth d touches nodes of depths d - 1, d and
    d + 1 only, so a round is cleared of the last two depths and of nothing older. Each depth is written once.
    """
    key = [GRAPH, "block", "node"]
    first = sources.select(GRAPH, F.col("source").alias("node"), *_word(F.col("source")))
    levels = [first.groupBy(*key).agg(F.bit_or("mask").alias("mask"))]
    arcs = adjacency(edges).withColumnRenamed("s", "node")
    for _ in range(max_depth):
        levels[-1] = stage(levels[-1], "frontier")
        reached = levels[-1].join(arcs, [GRAPH, "node"]).groupBy(GRAPH, "block", F.col("d").alias("node")).agg(F.bit_or("mask").alias("mask"))
        for old in levels[-2:]:
            reached = reached.join(old.withColumnRenamed("mask", "old"), key, "left").select(
                *key, F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("mask"))
        levels.append(reached.filter("mask <> 0"))
    return levels


def _sources_of(levels: list[DataFrame]) -> DataFrame:
    """``(graph_id, source, node, dist)`` of all bits."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("mask", b) == 1)
    rows = [x.select(GRAPH, "block", F.explode(bits).alias("bit"), "node", F.lit(depth).alias("dist")) for depth, x in enumerate(levels)]
    return reduce(DataFrame.unionByName, rows).select(GRAPH, (F.col("block") * WORD + F.col("bit")).alias("source"), "node", "dist")


#: Deepest walk that is made in blocks of sources.
WALK = 4


def bounded_distances(
    edges: DataFrame, sources: DataFrame, max_depth: int = 3, targets: DataFrame | None = None, block: int = blocks.BLOCK
) -> DataFrame:
    """Hop counts ``(graph_id, source, node, dist)`` up to ``max_depth`` from each source.

    The source itself has distance 0 and nodes out of reach are absent; ``max_depth <= 0`` gives
    no rows. ``sources`` is ``(graph_id, source)``; with ``targets``, ``(graph_id, source, node)``, only
    these pairs are returned, and none is searched from one end alone.

    Sources walk in blocks that hold the lists of all nodes they pass. One with more than ``block`` paths, or
    without any, and walks of more than ``WALK`` steps are made by joins.
    """
    sources = sources.select(GRAPH, "source").distinct()
    if max_depth <= 0:
        return _sources_of(bit_frontiers(edges, sources, 0)).limit(0)
    if targets is not None:
        wanted = targets.join(sources, [GRAPH, "source"], "left_semi")
        return set_distances(edges, wanted.select(GRAPH, "source", "node").distinct(), max_depth, -1, block).filter("dist >= 0")
    if max_depth > WALK:
        return _sources_of(bit_frontiers(edges, sources, max_depth))
    sources = stage(sources, "sources")
    arcs = blocks.with_onward(adjacency(edges), max_depth)
    lists = blocks.packed_lists(arcs)
    own, _, count = blocks.in_blocks(stage(lists.join(sources.withColumnRenamed("source", "node"), [GRAPH, "node"], "left_semi").select(GRAPH, "node", "load", "k"), "loads"), block, lists)
    found = blocks.reached(adjacency(edges), lists, own, count, max_depth).select(GRAPH, "source", F.explode("nodes").alias("node"), "dist")
    rest = stage(sources.join(own.withColumnRenamed("node", "source"), [GRAPH, "source"], "left_anti"), "sources")
    return found if rest.isEmpty() else found.union(_sources_of(bit_frontiers(edges, rest, max_depth)))


def set_distances(
    edges: DataFrame,
    pairs: DataFrame,
    max_depth: int = 3,
    default_far: int = 10,
    block: int = blocks.BLOCK,
) -> DataFrame:
    """Distance of every wanted pair ``(graph_id, source, node)``; ``default_far`` beyond reach.

    Sources walk in blocks and stop one step before ``max_depth``; the last step is the neighbours of the wanted
    nodes, so nothing is a row but the pairs found. Sources with more than ``block`` paths, and walks of
    more than ``WALK`` steps, meet halfway by joins.
    """
    key = [GRAPH, "source", "node"]
    if max_depth <= 0:
        return pairs.withColumn("dist", F.lit(default_far))
    asked = stage(pairs.select(*key).distinct(), "pairs")
    apart = asked.filter("source <> node")
    if max_depth > WALK:
        found = _met_halfway(edges, apart, max_depth)
    else:
        arcs = blocks.with_onward(adjacency(edges), max(1, max_depth - 1))
        lists = blocks.packed_lists(arcs)
        ends = apart.join(lists.select(GRAPH, "node", "k"), [GRAPH, "node"], "left").groupBy(GRAPH, F.col("source").alias("node")).agg(
            F.sum(F.lit(1.0) + F.coalesce("k", F.lit(0))).alias("ends"))
        loads = stage(lists.join(ends, [GRAPH, "node"]).select(GRAPH, "node", (F.col("load") + F.col("ends")).alias("load")), "loads")
        own, large, count = blocks.in_blocks(loads, block)
        found = blocks.pair_distances(adjacency(edges), lists, own, apart, count, max_depth)
        if not large.isEmpty():
            found = found.unionByName(_met_halfway(edges, apart.join(large.withColumnRenamed("node", "source"), [GRAPH, "source"], "left_semi"), max_depth))
    found = found.unionByName(asked.filter("source = node").withColumn("dist", F.lit(0)))
    return pairs.join(found, key, "left").withColumn("dist", F.coalesce("dist", F.lit(default_far)))


def _met_halfway(edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """``(graph_id, source, node, dist)`` of the pairs within reach, whose two ends meet in the middle.

    Balls of half the depth, rounded down, are spread around the end of smaller degree and joined to the pairs;
    balls of the other half stay packed, 64 centers a word, around the other end. A pair looks up its bit there
    for every node of its near ball, so no ball of the full depth is built and nothing is reached that no
    pair asks for.
    """
    key = [GRAPH, "source", "node"]
    deg = degrees(edges)
    ends = pairs.select(*key)
    for end in ("source", "node"):
        ends = ends.join(deg.select(GRAPH, F.col("s").alias(end), F.col("k").alias(f"k_{end}")), [GRAPH, end], "left")
    swap = F.coalesce("k_source", F.lit(0)) < F.coalesce("k_node", F.lit(0))
    ends = stage(ends.select(
        *key, F.when(swap, F.col("node")).otherwise(F.col("source")).alias("far"), F.when(swap, F.col("source")).otherwise(F.col("node")).alias("near")), "pairs")
    short = max_depth // 2
    near = _sources_of(bit_frontiers(edges, ends.select(GRAPH, F.col("near").alias("source")).distinct(), short))
    levels = bit_frontiers(edges, ends.select(GRAPH, F.col("far").alias("source")).distinct(), max_depth - short)
    far = reduce(DataFrame.unionByName, [x.withColumn("step", F.lit(depth)) for depth, x in enumerate(levels)])
    block, mask = _word(F.col("far"))
    asked = ends.join(near.select(GRAPH, F.col("source").alias("near"), F.col("node").alias("middle"), F.col("dist").alias("walked")), [GRAPH, "near"])
    asked = asked.select(*key, "middle", "walked", block, mask.alias("bit"))
    met = asked.join(far.withColumnRenamed("node", "middle"), [GRAPH, "block", "middle"]).filter(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    return met.groupBy(*key).agg(F.min(F.col("walked") + F.col("step")).alias("dist"))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` where both are positive, else 0."""
    return F.when((num > 0) & (den > 0), F.try_divide(num.cast("double"), den)).otherwise(0.0)
