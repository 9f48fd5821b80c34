import math
import random

import pytest

import brute
from edgegeom.columns import REPORT_COLUMNS
from edgegeom.plans.report import edge_report
from graphs import NAMED, frame


@pytest.fixture(scope="module")
def named(spark):
    rows = edge_report(frame(spark, NAMED)).collect()
    return {(r.graph_id, r.u, r.v): r for r in rows}


@pytest.mark.parametrize("graph", sorted(NAMED))
def test_named_graphs(named, graph):
    for (u, v), want in brute.edge_rows(NAMED[graph]).items():
        r = named[graph, u, v]
        assert list(r.asDict()) == REPORT_COLUMNS
        for name, value in want.items():
            assert r[name] == pytest.approx(value, abs=1e-9), (u, v, name)
        small, large = min(r.deg_u, r.deg_v), max(r.deg_u, r.deg_v)
        quads = r.n_quad / r.quad_cap if r.n_quad else 0
        forman = 2 / small + 2 / large - 2 + 2 * r.n_tri / large + r.n_tri / small + quads if small > 1 else 0
        assert (r.quad_term, r.bf) == (pytest.approx(quads), pytest.approx(forman))
        check_invariants(r)


def test_values_known_in_closed_form(named):
    n = 7  # in a clique all mass but one part in n - 1 stays
    r = named["clique7", 0, 1]
    assert (r.or_lazy, r.or_plain) == (pytest.approx(1), pytest.approx(1 - 1 / (n - 1)))
    leaf = named["broom1_6", 1, 2]
    assert (leaf.bf, leaf.or_plain) == (0, pytest.approx(0))


def check_invariants(r, eps=1e-9):
    small, large = min(r.deg_u, r.deg_v), max(r.deg_u, r.deg_v)
    assert r.or_lazy <= 1 + eps and r.or_plain <= 1 + eps
    assert small > 1 or r.bf == 0
    assert r.n_quad <= r.deg_u + r.deg_v - 2 - 2 * r.n_tri
    assert r.quad_term <= 2 - 2 / large + eps
    assert r.env_slope > 0
    assert r.env_at_tri == pytest.approx(r.env_const + r.env_slope * r.n_tri)
    assert r.or_lazy <= r.env_at_tri + eps and r.or_lazy <= r.env_transport + eps
    assert r.or_lo - eps <= r.or_lazy <= r.or_hi + eps
    assert r.bf_lo - eps <= r.bf <= r.bf_hi + eps
    gap = abs(1 / (r.deg_u + 1) - 1 / (r.deg_v + 1))
    keep = 1 / (large + 1) if r.or_plain >= 0 else 1 / (small + 1)
    assert r.or_lazy >= (1 - keep) * r.or_plain - gap - eps


@pytest.mark.parametrize("heavy_degree", [512, 3, 1])
def test_random_graphs_match_brute_force(spark, heavy_degree):
    """Many random graphs in one job; a low heavy degree sends hubs down the other path."""
    rng = random.Random(7)
    graphs = {
        f"g{i}": brute.random_graph(rng, rng.randint(3, 12), rng.uniform(0.05, 0.5))
        for i in range(120)
    }
    got = {(r.graph_id, r.u, r.v): r
           for r in edge_report(frame(spark, graphs), heavy_degree).collect()}
    want = {(g, u, v): row for g, edges in graphs.items()
            for (u, v), row in brute.edge_rows(edges).items()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name, value in row.items():
            assert math.isclose(got[key][name], value, abs_tol=1e-12), (key, name, graphs[key[0]])
        check_invariants(got[key])


def test_hub_with_shared_neighbors(spark):
    """Two hubs with many common neighbours, plus a ring between the leaves."""
    leaves = range(2, 30)
    edges = [(0, x) for x in leaves] + [(1, x) for x in leaves if x % 3]
    edges += [(x, x + 1) for x in range(2, 29, 2)]
    graphs = {"hubs": sorted(edges)}
    for heavy_degree in (512, 10):
        got = {(r.u, r.v): r for r in edge_report(frame(spark, graphs), heavy_degree).collect()}
        for key, row in brute.edge_rows(graphs["hubs"]).items():
            for name, value in row.items():
                assert math.isclose(got[key][name], value, abs_tol=1e-12), (key, name)


def test_large_hub_gives_the_same_either_way(spark):
    """A hub above the default heavy degree: walked around, or expanded as if it were small."""
    rng = random.Random(1)
    edges = {(0, i) for i in range(1, 1201)} | {(i, i + 1) for i in range(1, 1500)}
    while len(edges) < 3600:
        u, v = sorted(rng.sample(range(1500), 2))
        edges.add((u, v))
    pairs = frame(spark, {"hub": sorted(edges)})
    around = {tuple(r)[:3]: r for r in edge_report(pairs).collect()}
    expanded = {tuple(r)[:3]: r for r in edge_report(pairs, heavy_degree=5000).collect()}
    assert len(around) == 3600 and around == expanded
    for r in around.values():
        check_invariants(r)
