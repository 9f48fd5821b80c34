"""Reports of changed graphs: only the neighbourhood of the changes is computed anew.

A row of the report depends on the edges at its ends and on which of their neighbours touch or share
a neighbour. All of these lie at nodes next to the edge's ends, so a changed edge matters to the edges
with an end at most one hop from it, and to no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..columns import EDGE_KEY, GRAPH
from ..operators.clean import adjacency, canonical_edges, prepare
from ..operators.local import HEAVY_DEGREE
from ..staging import stage
from .report import report_of
from .suite import manifest

NODE = [GRAPH, "s"]


def _pairs(rows: DataFrame) -> DataFrame:
    return canonical_edges(rows.select(GRAPH, F.col("u").alias("src"), F.col("v").alias("dst")))


def _ends(edges: DataFrame) -> DataFrame:
    return adjacency(edges).select(*NODE).distinct()


def _at(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among the nodes."""
    arms = [edges.join(nodes.select(GRAPH, F.col("s").alias(end)), [GRAPH, end], "left_semi").select(*EDGE_KEY) for end in ("u", "v")]
    return arms[0].union(arms[1]).distinct()


def _ball(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes and all that touch them."""
    return _ends(_at(edges, nodes)).union(nodes).distinct()


def update_report(report: DataFrame, added: DataFrame, removed: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> tuple[DataFrame, DataFrame]:
    """The report after ``removed`` and then ``added`` pairs ``(graph_id, u, v)``, and the recomputed rows.

    ``report`` has a row for every edge of the old graphs. Pairs may come in any order, repeated, with
    loops; removing what is not there and adding what is there changes nothing.
    """
    old = stage(report.select(*EDGE_KEY), "old-edges")
    more, less = stage(_pairs(added), "added"), stage(_pairs(removed), "removed")
    lost = less.join(more, EDGE_KEY, "left_anti").join(old, EDGE_KEY, "left_semi")
    gained = more.join(old, EDGE_KEY, "left_anti")
    now = stage(old.join(lost, EDGE_KEY, "left_anti").union(gained), "new-edges")
    touched = _ends(lost.union(gained))
    near = stage(_ball(old.union(gained), touched), "touched")
    affected = stage(_at(now, near), "affected")
    around = _ball(now, _ends(affected))
    anew = stage(report_of(prepare(_at(now, around)), heavy_degree).join(affected, EDGE_KEY, "left_semi"), "anew")
    gone = affected.union(lost)
    kept = report.join(gone, EDGE_KEY, "left_anti")
    return kept.unionByName(anew.select(*report.columns)), anew


def update_manifest(runs: DataFrame, report: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The manifest of the changed ``report``: graphs without a changed pair keep their old rows."""
    changed = added.select(GRAPH).union(removed.select(GRAPH)).distinct()
    fresh = manifest(report.join(changed, GRAPH, "left_semi"))
    kept = runs.join(changed.withColumnRenamed(GRAPH, "tag"), "tag", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)
