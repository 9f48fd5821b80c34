import math

import pytest
from pyspark.sql import functions as F

from edgegeom.operators import builders as G


def pairs(df):
    rows = [(r.u, r.v) for r in df.collect()]
    assert len(rows) == len(set(rows)) and all(u < v for u, v in rows)
    return sorted(rows)


def nodes(spark, n):
    return G.node_table(spark, "g", n)


def test_regular_families(spark):
    assert pairs(G.cycle_edges(nodes(spark, 4))) == [(0, 1), (0, 3), (1, 2), (2, 3)]
    assert pairs(G.cycle_edges(nodes(spark, 2))) == [(0, 1)]
    assert pairs(G.grid_edges(nodes(spark, 6), 2, 3)) == [
        (0, 1), (0, 3), (1, 2), (1, 4), (2, 5), (3, 4), (4, 5)]
    assert len(pairs(G.torus_edges(nodes(spark, 12), 3, 4))) == 24
    assert len(pairs(G.torus_edges(nodes(spark, 6), 2, 3))) == 9
    assert pairs(G.tree_edges(nodes(spark, G.tree_size(2, 2)), 2)) == [
        (0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)]
    assert pairs(G.tree_edges(nodes(spark, G.tree_size(1, 3)), 1)) == [(0, 1), (1, 2), (2, 3)]
    assert [G.tree_size(*x) for x in ((3, -1), (0, 5), (1, 4), (3, 2))] == [0, 1, 5, 13]
    assert len(pairs(G.complete_edges(nodes(spark, 9)))) == 36


@pytest.mark.parametrize("p", [0.0, 0.003, 0.2, 1.0])
def test_bernoulli_share(spark, p):
    n = 300
    found = pairs(G.bernoulli_edges(nodes(spark, n), p, 5, n - 1))
    total = n * (n - 1) // 2
    spread = 5 * math.sqrt(total * p * (1 - p))
    assert abs(len(found) - total * p) <= spread
    assert all(0 <= u < v < n for u, v in found)


def test_bernoulli_is_free_of_partitioning(spark):
    one = pairs(G.bernoulli_edges(nodes(spark, 200), 0.05, 9, 199))
    two = pairs(G.bernoulli_edges(nodes(spark, 200).repartition(13), 0.05, 9, 199))
    other = pairs(G.bernoulli_edges(nodes(spark, 200), 0.05, 10, 199))
    assert one == two and one != other


def test_bernoulli_pairs_are_uniform(spark):
    """Over many seeds each pair of a small graph is kept about equally often."""
    n, rounds, p = 6, 400, 0.3
    base = spark.range(rounds * n).select(
        F.concat(F.lit("g"), F.floor(F.col("id") / n)).alias("graph_id"), (F.col("id") % n).alias("id"),
        F.lit(n).cast("long").alias("n"))
    counts = {(r.u, r.v): r["count"] for r in
              G.bernoulli_edges(base, p, 1, n - 1).groupBy("u", "v").count().collect()}
    assert len(counts) == 15
    limit = 4.5 * math.sqrt(rounds * p * (1 - p))
    assert all(abs(c - rounds * p) < limit for c in counts.values())


def test_block_edges(spark):
    sizes, odds = [40, 60, 50], [[0.5, 0.0, 0.1], [0.0, 1.0, 0.0], [0.1, 0.0, 0.0]]
    block = [0] * 40 + [1] * 60 + [2] * 50
    seen = {}
    for u, v in pairs(G.block_edges(nodes(spark, 150), sizes, odds, 4)):
        seen[block[u], block[v]] = seen.get((block[u], block[v]), 0) + 1
    assert set(seen) == {(0, 0), (0, 2), (1, 1)}
    assert seen[1, 1] == 60 * 59 // 2
    assert abs(seen[0, 0] - 390) < 70 and abs(seen[0, 2] - 200) < 70
    two = G.two_level_block_edges(nodes(spark, 9), G.halves(9), 1.0, 0.0, 1)
    assert len(pairs(two)) == 6 + 10


@pytest.mark.parametrize("sizes,odds", [
    ([2, 2], [[0.1, 0.2], [0.3, 0.1]]), ([2, 2], [[0.1, 1.2], [1.2, 0.1]]),
    ([2, 0], [[0.1, 0.2], [0.2, 0.1]]), ([2], [[0.1, 0.2]]),
])
def test_block_edges_reject_bad_input(spark, sizes, odds):
    with pytest.raises(ValueError):
        G.block_edges(nodes(spark, 4), sizes, odds, 1)


def test_radius_edges_match_all_pairs(spark):
    points = G.uniform_points(nodes(spark, 250), 3)
    rows = points.collect()
    want = sorted((a.id, b.id) for a in rows for b in rows
                  if a.id < b.id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 0.12 ** 2)
    assert pairs(G.radius_edges(points, F.lit(0.12))) == want


@pytest.mark.parametrize("radius,alpha", [(5.0, 1.0), (8.0, 0.7), (2.0, 1.3), (0.5, 1.0)])
def test_hyperbolic_edges_match_all_pairs(spark, radius, alpha):
    points = G.hyperbolic_points(nodes(spark, 200), radius, alpha, 8)
    rows = points.collect()
    limit = math.cosh(alpha * radius)
    assert all(1 <= r.c <= limit and abs(r.c ** 2 - r.s ** 2 - 1) < 1e-6 * r.c ** 2 for r in rows)
    want = sorted((a.id, b.id) for a in rows for b in rows if a.id < b.id
                  and a.c * b.c - a.s * b.s * math.cos(a.theta - b.theta) <= limit)
    assert pairs(G.hyperbolic_edges(points, radius, alpha)) == want


def pair_odds(rows, radius, alpha, temperature):
    out = {}
    for a in rows:
        for b in rows:
            if a.id < b.id:
                f = max(1.0, a.c * b.c - a.s * b.s * math.cos(a.theta - b.theta))
                x = (math.acosh(f) / alpha - radius) / (2 * temperature)
                out[a.id, b.id] = 1 / (1 + math.exp(min(x, 700.0)))
    return out


@pytest.mark.parametrize("radius,alpha,temperature", [(8.0, 0.9, 0.5), (5.0, 1.0, 0.9), (6.0, 0.7, 0.2)])
def test_soft_hyperbolic_share(spark, radius, alpha, temperature):
    """Numbers of links among near, middling and far pairs agree with their summed odds."""
    points = G.hyperbolic_points(nodes(spark, 300), radius, alpha, 4)
    odds = pair_odds(points.collect(), radius, alpha, temperature)
    found = set(pairs(G.soft_hyperbolic_edges(points, radius, alpha, temperature, 6)))
    assert found <= set(odds)
    for low, high in ((0.0, 0.05), (0.05, 0.5), (0.5, 1.01)):
        group = {k: p for k, p in odds.items() if low <= p < high}
        spread = math.sqrt(sum(p * (1 - p) for p in group.values()))
        assert abs(len(found & set(group)) - sum(group.values())) <= 4.5 * spread + 1


def test_soft_hyperbolic_at_low_temperature_is_hard(spark):
    points = G.hyperbolic_points(nodes(spark, 250), 7.0, 0.8, 2)
    soft = pairs(G.soft_hyperbolic_edges(points, 7.0, 0.8, 1e-7, 3))
    assert soft == pairs(G.hyperbolic_edges(points, 7.0, 0.8))
