"""Column names shared by every operator.

A graph is a DataFrame ``(graph_id, u, v)`` with ``u < v``; one DataFrame may hold any number of
graphs, and every operator keys its joins and groups by ``graph_id`` first.
"""

GRAPH = "graph_id"
EDGE_KEY = [GRAPH, "u", "v"]
EDGE_SCHEMA = "graph_id STRING, u BIGINT, v BIGINT"

#: Columns of the per-edge report, in output order.
REPORT_COLUMNS = [
    "graph_id", "u", "v", "deg_u", "deg_v", "n_tri", "n_quad", "quad_cap", "quad_term",
    "bf", "or_lazy", "or_plain", "env_const", "env_slope", "env_at_tri", "env_transport",
    "or_lo", "or_hi", "bf_lo", "bf_hi",
]
