"""Small graphs of a few families, built by rule."""

from itertools import combinations


def fan(k):
    """Node 0 joined to every node of a path of k links; fan(1) is a triangle."""
    return [(0, i) for i in range(1, k + 2)] + [(i, i + 1) for i in range(1, k + 1)]


def theta(k):
    """Nodes 0 and 1 joined through k middle nodes."""
    return [(end, 2 + i) for end in (0, 1) for i in range(k)]


def prism(k):
    """Two rings of k nodes, joined node by node."""
    ring = [tuple(sorted((i, (i + 1) % k))) for i in range(k)]
    return ring + [(u + k, v + k) for u, v in ring] + [(i, i + k) for i in range(k)]


def broom(stem, leaves):
    """A path of ``stem`` links with leaves at its end."""
    return [(i, i + 1) for i in range(stem)] + [(stem, stem + 1 + i) for i in range(leaves)]


NAMED = {
    "fan1": fan(1), "fan4": fan(4), "theta1": theta(1), "theta3": theta(3), "prism3": prism(3), "prism5": prism(5),
    "broom2_2": broom(2, 2), "broom1_6": broom(1, 6), "clique7": list(combinations(range(7), 2)),
}


def frame(spark, graphs):
    rows = [(name, u, v) for name, edges in graphs.items() for u, v in edges]
    return spark.createDataFrame(rows, "graph_id STRING, u BIGINT, v BIGINT")
