import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from edgegeom.operators import clean as N
from graphs import NAMED, frame


def arcs(spark, rows):
    return spark.createDataFrame([("g", s, d) for s, d in rows], "graph_id STRING, src BIGINT, dst BIGINT")


def pairs(df):
    return sorted((r.u, r.v) for r in df.collect())


@pytest.mark.parametrize("given,want", [
    ([(7, 3), (5, 2), (7, 7), (2, 5), (5, 2)], [(2, 5), (3, 7)]),
    ([(8, 4), (4, 4), (6, 8), (4, 6), (8, 6), (8, 4)], [(4, 6), (4, 8), (6, 8)]),
])
def test_canonical_edges(spark, given, want):
    edges = N.canonical_edges(arcs(spark, given))
    assert pairs(edges) == want
    assert {r.k for r in N.degrees(edges).collect()} == {1 if len(want) == 2 else 2}


def test_neighbor_lists_and_counts(spark):
    edges = frame(spark, {"fork": [(0, 4), (0, 6), (0, 9)], "fan1": NAMED["fan1"]})
    lists = {(r.graph_id, r.s): r.ns for r in N.neighbor_lists(edges).collect()}
    assert lists["fork", 0] == [4, 6, 9] and lists["fan1", 1] == [0, 2]
    assert {r.graph_id: r.n for r in N.node_count(edges).collect()} == {"fork": 10, "fan1": 3}
    nodes = spark.range(3, 7).select(F.lit("fork").alias("graph_id"), F.col("id").alias("s"))
    assert {r.s: r.k for r in N.node_degrees(nodes, edges).collect()} == {3: 0, 4: 1, 5: 0, 6: 1}


@pytest.mark.parametrize("agg,want", [
    ("mean", [1.5, 4, 5]), ("sum", [3, 8, 10]), ("min", [1, 3, 4]), ("max", [2, 5, 6]),
    ("first", [1, 3, 4]),
])
def test_arc_values(spark, agg, want):
    rows = [(3, 5), (5, 3), (9, 3), (5, 9), (3, 9), (9, 5), (5, 5)]
    values = spark.createDataFrame(
        [("g", i, s, d, float(i + 1)) for i, (s, d) in enumerate(rows)],
        "graph_id STRING, pos BIGINT, src BIGINT, dst BIGINT, value DOUBLE")
    edges = frame(spark, {"g": [(3, 5), (3, 9), (5, 9), (11, 12)]})
    got = sorted(N.arc_values_to_edges(edges, values, agg).collect())
    assert [r.value for r in got[:3]] == want
    assert math.isnan(got[3].value)


def test_arc_values_rejects_unknown_aggregate(spark):
    edges = frame(spark, {"g": [(0, 1)]})
    with pytest.raises(ValueError, match="unknown aggregate"):
        N.arc_values_to_edges(edges, edges, "median")


def test_edgewise_needs_every_edge(spark):
    edges = frame(spark, {"g": [(0, 1), (1, 2)]})
    assert {r.z for r in N.edgewise(edges, 0.5, "z").collect()} == {0.5}
    part = edges.filter("u = 0").withColumn("x", F.lit(2.0))
    with pytest.raises(Exception, match="no value for some edge"):
        N.edgewise(edges, part, "z").collect()


def path(n):
    return [(i, i + 1) for i in range(n - 1)]


def test_bounded_distances(spark):
    edges = frame(spark, {"p": path(6)})
    source = spark.createDataFrame([("p", 0)], "graph_id STRING, source BIGINT")
    got = {r.node: r.dist for r in N.bounded_distances(edges, source, 3).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}
    assert N.bounded_distances(edges, source, 0).collect() == []


@pytest.mark.parametrize("n,rows,want", [
    (6, [(0, 3), (0, 4), (0, 5)], {(0, 3): 3, (0, 4): 10, (0, 5): 10}),
    (4, [(0, 2), (0, 3), (1, 2), (1, 3)], {(0, 2): 2, (0, 3): 3, (1, 2): 1, (1, 3): 2}),
])
def test_set_distances(spark, n, rows, want):
    wanted = spark.createDataFrame([("p", a, b) for a, b in rows],
                                   "graph_id STRING, source BIGINT, node BIGINT")
    got = N.set_distances(frame(spark, {"p": path(n)}), wanted).collect()
    assert {(r.source, r.node): r.dist for r in got} == want


def walked(edges, source, depth):
    """Plain breadth-first hop counts."""
    adj = brute.adjacency(edges)
    seen, frontier = {source: 0}, {source}
    for d in range(1, depth + 1):
        frontier = {x for n in frontier for x in adj.get(n, ())} - seen.keys()
        seen |= {x: d for x in frontier}
    return seen


@pytest.fixture(scope="module")
def far_ids():
    """Sparse random graphs with negative, spread and very large ids."""
    rng = random.Random(31)
    graphs = {}
    for i in range(12):
        n = rng.randint(5, 60)
        ids = sorted(rng.sample([*range(-200, 200), *range(2**62, 2**62 + 70), 2**63 - 1, -(2**63)], n))
        graphs[f"g{i}"] = [(ids[a], ids[b]) for a, b in brute.random_graph(rng, n, 0.02)]
    return graphs


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_distances_of_random_graphs(spark, far_ids, depth):
    rng = random.Random(depth)
    edges = frame(spark, far_ids)
    sources = [(g, s) for g, e in far_ids.items() for s in rng.sample(sorted(brute.adjacency(e)), 4)] + [("g0", 777)]
    given = spark.createDataFrame(sources * 2, "graph_id STRING, source BIGINT")
    want = {(g, s, n): d for g, s in sources for n, d in walked(far_ids[g], s, depth).items()}
    found = N.bounded_distances(edges, given, depth).collect()
    assert len(found) == len(want) and {(r.graph_id, r.source, r.node): r.dist for r in found} == want
    wanted = [(g, s, rng.choice([*brute.adjacency(far_ids[g]), 778])) for g, s in sources for _ in range(6)] + [("g0", 777, 777)]
    pairs = spark.createDataFrame([(*r, "kept") for r in wanted], "graph_id STRING, source BIGINT, node BIGINT, note STRING")
    found = N.set_distances(edges, pairs, depth, 99).collect()
    assert sorted((r.graph_id, r.source, r.node, r.dist) for r in found) == sorted((*r, want.get(r, 99)) for r in wanted)
    near = N.bounded_distances(edges, given, depth, pairs.drop("note")).collect()
    assert {(r.graph_id, r.source, r.node): r.dist for r in near} == {r: want[r] for r in wanted if r in want}


def test_no_ball_of_the_full_depth(spark):
    """Pairs in a star of stars: the full ball of every source would be the whole graph."""
    edges = [(0, i) for i in range(1, 2001)] + [(i, 2000 + i) for i in range(1, 2001)]
    pairs = spark.createDataFrame([("s", 2000 + i, 2000 - i) for i in range(1, 1000)], "graph_id STRING, source BIGINT, node BIGINT")
    assert {r.dist for r in N.set_distances(frame(spark, {"s": edges}), pairs, 3).collect()} == {3}


def test_safe_ratio(spark):
    df = spark.createDataFrame([(0, 5), (3, 0), (3, 6)], "a BIGINT, b BIGINT")
    got = [r[0] for r in df.select(N.safe_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 0.0, 0.5]


@pytest.mark.parametrize("arcs_per_key", [1, 3, 1 << 16])
def test_degrees_of_hot_nodes(spark, arcs_per_key):
    edges = frame(spark, {"star": [(0, i) for i in range(1, 40)] + [(1, 2)], "fan1": NAMED["fan1"]})
    got = {(r.graph_id, r.u, r.v): (r.deg_u, r.deg_v)
           for r in N.with_degrees(edges, arcs_per_key).collect()}
    assert len(got) == 43
    assert got["star", 0, 1] == (39, 2) and got["star", 0, 9] == (39, 1)
    assert got["star", 1, 2] == (2, 2) and got["fan1", 0, 2] == (2, 2)
