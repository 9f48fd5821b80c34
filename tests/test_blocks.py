"""Counts and walks in blocks of nodes against the same from sets and against joins."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from edgegeom.operators import blocks as K, clean as N, local as L
from edgegeom.operators.clean import prepare
from edgegeom.columns import EDGE_KEY
from graphs import frame


@pytest.mark.parametrize("ids", [[5], [1, 2], [-3, 7, 10**15], [0, 300, 70_000], [-(2**63), 2**63 - 1]])
def test_packed_lists_come_back(ids):
    assert K._unpack(K._pack(np.array(ids))).tolist() == ids


def test_many_lists_come_back_at_once():
    rng = np.random.default_rng(2)
    lists = [None] + [np.unique(rng.integers(-top, top, n)) for top in (3, 200, 70_000, 1 << 40, 1 << 62) for n in (1, 2, 9, 500)] + [None]
    ids = [x for x in lists if x is not None]
    whole = K._pack_all(np.concatenate(ids), np.array([*map(len, ids)]))
    assert whole.to_pylist() == [K._pack(x) for x in ids]
    data = pa.array([None, *whole.to_pylist(), None], pa.binary())
    for part in (slice(None), slice(3, 9), slice(0, 1)):
        flat, size = K._unpack_all(data[part])
        want = [x for x in lists[part] if x is not None]
        assert flat.tolist() == [y for x in want for y in x.tolist()]
        assert size.tolist() == [0 if x is None else len(x) for x in lists[part]]


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_lists_of_sorted_arcs(size):
    """Nodes that end within a batch, at its end, or go on over several."""
    nodes = [("a", 1, [5]), ("a", 2, [1, 3, 9]), ("b", 2, [4]), ("b", 7, [*range(0, 900, 100)]), ("c", 7, [8, 9])]
    rows = [(g, n, d, 0.5) for g, n, ends in nodes for d in ends]
    schema = pa.schema([("graph_id", pa.string()), ("node", pa.int64()), ("d", pa.int64()), ("load", pa.float64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[at:at + size]], schema) for at in range(0, len(rows), size)]
    made = [x for batch in K._pack_sorted(iter([batches[0].slice(0, 0), *batches])) for x in batch.to_pylist()]
    assert [(x["graph_id"], x["node"], K._unpack(x["ns"]).tolist(), x["k"], x["load"]) for x in made] == [(*x, len(x[2]), len(x[2]) / 2) for x in nodes]


def lists_of(edges, own):
    adj = brute.adjacency(edges)
    nodes = sorted(adj)
    data = K._pack_all(np.array([x for n in nodes for x in sorted(adj[n])]), np.array([len(adj[n]) for n in nodes]))
    return K.Lists(np.array(nodes), np.array([n in own for n in nodes]), data)


@pytest.mark.parametrize("shift", [1, 1 << 33])
@pytest.mark.parametrize("cells", [1, 60, 1 << 23])
def test_counts_do_not_depend_on_the_run(monkeypatch, cells, shift):
    """Runs of one node, of a few and of all of them, with numbers of their own where these are fewer."""
    rng = random.Random(4)
    edges = [(u * shift, v * shift) for u, v in brute.random_graph(rng, 40, 0.15)]
    own = {n * shift for n in range(0, 40, 3)}
    adj = brute.adjacency(edges)
    monkeypatch.setattr(K, "CELLS", cells)
    monkeypatch.setattr(K, "STEP", max(1, cells // 4))
    got = {}
    for part in K._count_codegrees(lists_of(edges, own), None):
        for u, v, through, is_open in zip(*(part[c].tolist() for c in ("u", "v", "through", "open"))):
            got.setdefault((u, v), []).append((through, is_open))
    want = {}
    for p in own & adj.keys():
        for c in adj[p]:
            others = {q: (adj[p] & adj[q]) - {c} for q in adj[c] - {p}}
            open_ = sum(any(w not in adj[c] for w in common) for q, common in others.items() if q not in adj[p])
            want.setdefault((min(p, c), max(p, c)), []).append((max(map(len, others.values()), default=0), open_))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}


def test_runs_do_not_shrink_in_a_wide_block():
    """Nodes of a block that have no neighbour in common: once a run had room for a row of all of them, for few nodes."""
    n = 60_000
    lists = lists_of([(u, n + 5 * u + k) for u in range(n) for k in range(5)], set(range(n)))
    assert len(lists.ids) == 6 * n
    steps = [*lists.near_steps()]
    assert sum(len(own) for own, _ in steps) == n and len(steps) < 100
    assert max(cells for _, cells in steps) <= K.CELLS


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    shift = {0: 0, 1: -40, 2: 1 << 40}
    graphs = {f"g{i}": [(u + shift[i % 3], v + shift[i % 3]) for u, v in brute.random_graph(rng, rng.randint(4, 20), rng.uniform(0.1, 0.7))] for i in range(30)}
    return {g: e for g, e in graphs.items() if e}, prepare(frame(spark, graphs))


@pytest.mark.parametrize("block", [K.BLOCK, 40, 0])
def test_triangles_per_edge(many, block):
    graphs, degreed = many
    want = {}
    for g, edges in graphs.items():
        adj = brute.adjacency(edges)
        want |= {(g, u, v): len(adj[u] & adj[v]) for u, v in edges if adj[u] & adj[v]}
    got = L.triangles_per_edge(degreed, block)
    assert {(r.graph_id, r.u, r.v): r.n_tri for r in got.select(*EDGE_KEY, "n_tri").collect()} == want


def test_no_wedge_is_a_row(spark):
    """A graph of 400 nodes, each next to a quarter of the others, has a million wedges."""
    rng = random.Random(8)
    degreed = prepare(frame(spark, {"g": [(u, v) for u in range(400) for v in range(u + 1, 400) if rng.random() < 0.25]}))
    for made in (L.triangles_per_edge(degreed), L.quad_counts(degreed)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "posexplode" not in plan
        assert plan.count("Join Inner") <= 1


def hops(adj, source, most):
    found, edge = {source: 0}, {source}
    for step in range(1, most + 1):
        edge = {w for x in edge for w in adj.get(x, ())} - found.keys()
        found |= dict.fromkeys(edge, step)
    return found


@pytest.mark.parametrize("block", [K.BLOCK, 60, 0])
@pytest.mark.parametrize("depth", [1, 2, 3, 4, 6])
def test_walks(spark, block, depth):
    rng = random.Random(3)
    graphs = {f"g{i}": [(u, v) for u, v in brute.random_graph(rng, 24, 0.08)] or [(0, 1)] for i in range(4)}
    edges = frame(spark, graphs).localCheckpoint()
    near = {(g, s): hops(brute.adjacency(e), s, depth) for g, e in graphs.items() for s in range(-1, 24)}
    sources = spark.createDataFrame(list(near), "graph_id string, source bigint")
    got = N.bounded_distances(edges, sources, depth, block=block).collect()
    want = {(g, s, n, d) for (g, s), found in near.items() for n, d in found.items()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    asked = [(g, s, n) for g, s in near for n in (s, -1, 99, *rng.sample(range(24), 5))]
    got = N.set_distances(edges, spark.createDataFrame(asked, "graph_id string, source bigint, node bigint"), depth, 10, block).collect()
    assert sorted(tuple(r) for r in got) == sorted((g, s, n, near[g, s].get(n, 10)) for g, s, n in asked)


def test_balls_are_not_joined_to_pairs(spark):
    edges = frame(spark, {"g": [(u, (u + k) % 60) if u < (u + k) % 60 else ((u + k) % 60, u) for u in range(60) for k in (1, 7)]})
    pairs = spark.createDataFrame([("g", u, 59 - u) for u in range(60)], "graph_id string, source bigint, node bigint")
    plan = N.set_distances(edges, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "middle" not in plan


@pytest.mark.parametrize("block", [K.BLOCK, 40, 0])
def test_exclusive_neighbors(many, block):
    graphs, degreed = many
    want = set()
    for g, edges in graphs.items():
        adj = brute.adjacency(edges)
        want |= {(g, u, v, "u", n) for u, v in edges for n in adj[u] - adj[v] - {v}} | {(g, u, v, "v", n) for u, v in edges for n in adj[v] - adj[u] - {u}}
    made = L.exclusive_neighbors(degreed, block=block)
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(want) and set(got) == want
    if block == K.BLOCK:
        # No row of a neighbour is joined.
        assert "edge_part" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1, 300, 1 << 25])
def test_lists_reach_the_blocks_that_need_them(monkeypatch, most):
    """Blocks that begin within a graph, with it, and before it; negative ids; lists dealt in small parts."""
    monkeypatch.setattr(K, "DEALT", most)
    rng = random.Random(6)
    graphs = {f"g{i}": brute.adjacency([(u - 9, v - 9) for u, v in brute.random_graph(rng, 30, 0.2)]) for i in range(3)}
    every = sorted((g, n) for g, adj in graphs.items() for n in adj)
    starts = [(*every[at], 2 * at) for at in (0, 7, 8, 25, 61)]
    block = {x: max(s for s in starts if s[:2] <= x)[2] for x in every}
    rows = [{"graph_id": g, "node": n, "ns": K._pack(np.array(sorted(graphs[g][n])))} for g, n in every]
    schema = pa.schema([("graph_id", pa.string()), ("node", pa.int64()), ("ns", pa.binary())])
    batches = [pa.RecordBatch.from_pylist(rows[at:at + 40], schema) for at in range(0, len(rows) + 40, 40)]
    got = []
    for x in K._deal(starts)(iter(batches)):
        for i in range(x.num_rows):
            row = pa.Table.from_batches([x.slice(i, 1)])
            nodes, own, data = K._opened(row)
            got += [(row["block"][0].as_py(), row["graph_id"][0].as_py(), n, o, K._unpack(d)) for n, o, d in zip(nodes.tolist(), own.tolist(), data.to_pylist())]
    want = {(b, g, n, b == block[g, n]) for g, n in every for b in {block[g, n], *(block[g, x] for x in graphs[g][n])}}
    assert len(got) == len(want) and {x[:4] for x in got} == want
    assert all(ids.tolist() == sorted(graphs[g][n]) for _, g, n, _, ids in got)


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_arcs_of_one_key_come_in_order(size):
    """Keys that end within a batch or go on over several, some of them shared by nodes and graphs."""
    rng = random.Random(size)
    nodes = [(3, "a", 1), (3, "b", 1), (3, "a", 1 << 44), (5, "b", 2), (8, None, 2), (8, "a", 2), (9, "a", 3)]
    rows = [(g, n, d, 1.0, key) for key, g, n in nodes for d in range(0, 40, 1 + n % 7)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[4])
    schema = pa.schema([("graph_id", pa.string()), ("node", pa.int64()), ("d", pa.int64()), ("load", pa.float64()), ("key", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[at:at + size]], schema) for at in range(0, len(rows), size)]
    made = [x for batch in K._pack_sorted(K._in_order(iter([batches[0].slice(0, 0), *batches]))) for x in batch.to_pylist()]
    assert len(made) == len(nodes)
    assert {(x["graph_id"], x["node"]): K._unpack(x["ns"]).tolist() for x in made} == {(g, n): [*range(0, 40, 1 + n % 7)] for _, g, n in nodes}


def test_lists_are_sorted_by_one_number(spark):
    """A sort by one number takes no comparisons of rows; ids that agree in their lower bits stay apart."""
    rows = [(g, n << 44, d) for g in ("a", "b") for n in range(-3, 4) for d in range(n + 5)]
    arcs = spark.createDataFrame(rows, "graph_id string, s bigint, d bigint").withColumn("load", F.lit(1.0))
    made = K.packed_lists(arcs).collect()
    assert {(x.graph_id, x.node): (K._unpack(x.ns).tolist(), x.k, x.load) for x in made} == {
        (g, n << 44): ([*range(n + 5)], n + 5, n + 5.0) for g in ("a", "b") for n in range(-3, 4)}


@pytest.mark.parametrize("hops", [0, 1, 2, 3, 4])
def test_runs_are_cut_by_the_paths_of_own_nodes(monkeypatch, hops):
    """Every run ends before the node that reaches ``STEP`` paths of up to that many arcs, counted for own nodes."""
    edges = brute.random_graph(random.Random(6), 30, 0.2)
    adj = brute.adjacency(edges)
    own = {*range(0, 30, 2)} & {*adj}
    load = dict.fromkeys(adj, 1)
    for _ in range(hops):
        load = {n: 1 + sum(load[x] for x in adj[n]) for n in adj}
    want, gone = [], 0
    for n in sorted(own):
        gone += load[n]
        if want and gone < 90:
            want[-1].append(n)
        else:
            want.append([n])
            gone = load[n]
    monkeypatch.setattr(K, "STEP", 90)
    lists = lists_of(edges, own)
    assert [lists.ids[x].tolist() for x in lists.steps(hops)] == want


def test_paths_of_two_arcs_read_no_list_of_another_node():
    """Runs of two arcs are cut by sizes alone, so lists of other nodes are not followed."""
    edges = brute.random_graph(random.Random(6), 30, 0.2)
    lists, read = lists_of(edges, {0, 4, 8}), []
    ends = lists.ends
    lists.ends = lambda nodes: read.append(lists.ids[nodes].tolist()) or ends(nodes)
    flat, lists.flat = lists.flat, lists.flat.copy()
    keep = np.concatenate([np.arange(a, a + k) for a, k in zip(lists.start[lists.of[lists.own]], lists.size[lists.of[lists.own]])])
    lists.flat[np.setdiff1d(np.arange(len(flat)), keep)] = len(lists.ids)  # no place
    assert len([*lists.near_steps()]) == 1 and read == [[0, 4, 8]]
