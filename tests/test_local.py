"""Codegree counts against listed 4-cycles, and hubs that share very many neighbours."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from edgegeom.operators import local as L
from edgegeom.operators.clean import prepare
from edgegeom.columns import EDGE_KEY
from graphs import frame


def listed_counts(degreed):
    """Counts per edge from the table of all 4-cycles."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("k").alias("node")), F.struct(F.lit(1).alias("side"), F.col("w").alias("node")))
    per_node = L.quads(degreed).select(*EDGE_KEY, "excl", F.inline(sides)).groupBy(*EDGE_KEY, "side", "node").agg(
        F.count("*").alias("through"), F.max(F.col("excl").cast("int")).alias("open"))
    return per_node.groupBy(*EDGE_KEY).agg(F.sum("open").alias("n_quad"), F.max("through").alias("codeg_max"))


def rows(df):
    return sorted(tuple(r) for r in df.select(*EDGE_KEY, "n_quad", "codeg_max").collect())


def hubs_and_leaves(rng, hubs, leaves, p, q):
    """Hubs joined to many leaves, some hubs and some leaves to each other."""
    edges = {(h, hubs + x) for h in range(hubs) for x in range(leaves) if rng.random() < p}
    edges |= {(a, b) for a in range(hubs) for b in range(a + 1, hubs) if rng.random() < 0.5}
    edges |= {tuple(sorted(rng.sample(range(hubs, hubs + leaves), 2))) for _ in range(int(q * leaves))}
    return sorted(edges)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(21)
    graphs = {f"g{i}": brute.random_graph(rng, rng.randint(4, 16), rng.uniform(0.1, 0.6)) for i in range(60)}
    graphs |= {f"h{i}": hubs_and_leaves(rng, rng.randint(2, 5), rng.randint(10, 30), rng.uniform(0.2, 0.9), rng.random()) for i in range(30)}
    return graphs, prepare(frame(spark, graphs))


@pytest.mark.parametrize("heavy_degree", [512, 5, 2, 0])
def test_counts_equal_listed_cycles(many, heavy_degree):
    graphs, degreed = many
    got = rows(L.quad_counts(degreed, heavy_degree))
    assert got == rows(listed_counts(degreed))
    if heavy_degree == 5:
        found = {r[:3]: r[3:] for r in got}
        for g, edges in graphs.items():
            adj = brute.adjacency(edges)
            for u, v in edges:
                nu, nv = adj[u], adj[v]
                only_u, only_v = nu - nv - {v}, nv - nu - {u}
                n = sum(bool(adj[k] & only_v) for k in only_u) + sum(bool(adj[w] & only_u) for w in only_v)
                most = max([len(adj[k] & nv) - 1 for k in nu - {v}] + [len(adj[w] & nu) - 1 for w in nv - {u}] + [0])
                assert found.get((g, u, v), (0, 0)) == (n, most)


def test_two_hubs_share_a_hundred_thousand_neighbours(spark):
    """Pairs of the shared neighbours would be five thousand million."""
    n = 100_000
    leaves = spark.range(2, n + 2)
    edges = leaves.select(F.lit("two").alias("graph_id"), F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("u"), F.col("id").alias("v"))
    extra = frame(spark, {"two": [(2, 3), (0, n + 2), (n + 2, n + 3)]})
    got = L.quad_counts(prepare(edges.unionByName(extra)))
    found = got.groupBy("n_quad", "codeg_max").agg(F.count("*").alias("edges")).collect()
    # A leaf's edge meets all other leaves and the other hub; those of the two joined leaves miss each other.
    assert {(r.n_quad, r.codeg_max): r.edges for r in found} == {(n, n - 1): 2 * (n - 2), (n - 1, n - 1): 4}


@pytest.mark.parametrize("heavy_degree", [512, 5])
def test_structure_of_every_edge(many, heavy_degree):
    """With and without graphs that have heavy nodes beside the others, edges on no cycle included."""
    graphs, degreed = many
    listed = {tuple(r)[:3]: tuple(r)[3:] for r in listed_counts(degreed).collect()}
    want = set()
    for g, edges in graphs.items():
        adj = brute.adjacency(edges)
        for u, v in edges:
            n_quad, most = listed.get((g, u, v), (0, 0))
            want.add((g, u, v, len(adj[u]), len(adj[v]), len(adj[u] & adj[v]), n_quad, most, most * max(len(adj[u]), len(adj[v]))))
    got = [tuple(r) for r in L.local_structure(degreed, heavy_degree).collect()]
    assert len(got) == len(want) and set(got) == want


def test_structure_is_one_walk(spark):
    """Neither lists nor counts are joined: arcs were met with blocks, and triangles walked apart from 4-cycles."""
    degreed = prepare(frame(spark, {"g": [(u, u + k) for u in range(50) for k in (1, 2, 5)]}))
    plan = L.local_structure(degreed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "MapInArrow" in plan and "Join" not in plan
