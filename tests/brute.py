"""Direct set formulas and exact transport in rationals; shares no code with the package."""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations


def adjacency(edges):
    adj = {}
    for u, v in edges:
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    return adj


def hops(adj, a, b):
    if a == b:
        return 0
    if b in adj[a]:
        return 1
    return 2 if adj[a] & adj[b] else 3


def transport(cost, supply, demand):
    """Cheapest plan value by repeated cheapest augmenting routes (Bellman-Ford, exact)."""
    m, n = len(supply), len(demand)
    supply, demand = list(supply), list(demand)
    flow = [[0] * n for _ in range(m)]
    while any(supply):
        best = {("l", i): (0, None) for i in range(m) if supply[i]}
        changed = True
        while changed:
            changed = False
            for i in range(m):
                for j in range(n):
                    if ("l", i) in best:
                        d = best["l", i][0] + cost[i][j]
                        if ("r", j) not in best or d < best["r", j][0]:
                            best["r", j] = (d, ("l", i))
                            changed = True
                    if ("r", j) in best and flow[i][j]:
                        d = best["r", j][0] - cost[i][j]
                        if ("l", i) not in best or d < best["l", i][0]:
                            best["l", i] = (d, ("r", j))
                            changed = True
        end = min((j for j in range(n) if demand[j]), key=lambda j: best["r", j][0])
        route, at = [], ("r", end)
        while best[at][1] is not None:
            route.append((best[at][1], at))
            at = best[at][1]
        amount = min(supply[at[1]], demand[end])
        for a, b in route:
            if a[0] == "r":
                amount = min(amount, flow[b[1]][a[1]])
        for a, b in route:
            if a[0] == "l":
                flow[a[1]][b[1]] += amount
            else:
                flow[b[1]][a[1]] -= amount
        supply[at[1]] -= amount
        demand[end] -= amount
    return sum(cost[i][j] * flow[i][j] for i in range(m) for j in range(n))


def uniform_cost(adj, left, right):
    left, right = sorted(left), sorted(right)
    cost = [[hops(adj, a, b) for b in right] for a in left]
    total = transport(cost, [len(right)] * len(left), [len(left)] * len(right))
    return Fraction(total, len(left) * len(right))


def edge_rows(edges):
    """``{(u, v): dict}`` with structure and both transport curvatures."""
    adj = adjacency(edges)
    rows = {}
    for u, v in edges:
        nu, nv = adj[u], adj[v]
        common = nu & nv
        only_u, only_v = nu - nv - {v}, nv - nu - {u}
        n_quad = sum(bool(adj[k] & only_v) for k in only_u) + sum(
            bool(adj[w] & only_u) for w in only_v)
        codeg = max([len(adj[k] & (nv - {u})) for k in nu - {v}]
                    + [len(adj[w] & (nu - {v})) for w in nv - {u}] + [0])
        rows[u, v] = {
            "deg_u": len(nu), "deg_v": len(nv), "n_tri": len(common), "n_quad": n_quad,
            "quad_cap": codeg * max(len(nu), len(nv)),
            "or_lazy": float(1 - uniform_cost(adj, nu | {u}, nv | {v})),
            "or_plain": float(1 - uniform_cost(adj, nu, nv)),
        }
    return rows


def random_graph(rng, n, p):
    """Random spanning tree plus each other pair with probability p."""
    edges = {(rng.randrange(i), i) for i in range(1, n)}
    edges |= {pair for pair in combinations(range(n), 2) if rng.random() < p}
    return sorted(edges)
