"""Changed graphs, kept results and interrupted runs."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

import brute
from edgegeom.operators.clean import prepare
from edgegeom.plans.changes import update_manifest, update_report
from edgegeom.plans.report import edge_report
from edgegeom.plans.store import GraphStore, graph_digests
from edgegeom.plans.suite import manifest
from edgegeom.staging import scratch, stage
from graphs import NAMED, frame

PAIRS = "graph_id STRING, u BIGINT, v BIGINT"


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def local(path):
    return pathlib.Path(path.removeprefix("file:"))


def test_scratch_tables_go_with_their_folder(spark, tmp_path):
    with scratch(spark) as folder:
        edge_report(frame(spark, {"a": NAMED["fan4"]})).write.parquet(f"{tmp_path}/report")
        assert any(x.is_dir() for x in local(folder).iterdir())
    assert not local(folder).exists() and spark.read.parquet(f"{tmp_path}/report").count() == len(NAMED["fan4"])
    with pytest.raises(RuntimeError, match="stops"), scratch(spark) as folder:
        stage(frame(spark, {"a": NAMED["fan4"]}), "edges")
        raise RuntimeError("stops")
    assert not local(folder).exists() and stage(frame(spark, {"a": NAMED["fan4"]}), "edges").count() == len(NAMED["fan4"])


def test_random_changes_equal_a_full_run(spark, heavy_degree=4):
    rng = random.Random(41)
    old, new, added, removed = {}, {}, [], []
    for i in range(40):
        g, n = f"g{i}", rng.randint(4, 40)
        old[g] = brute.random_graph(rng, n, 2 / n)
        gone = rng.sample(old[g], rng.randint(0, min(3, len(old[g]) - 1)))
        come = [tuple(sorted(rng.sample(range(n + 2), 2))) for _ in range(rng.randint(0, 3))]
        new[g] = sorted((set(old[g]) - set(gone)) | set(come))
        removed += [(g, v, u) for u, v in gone] + [(g, 0, n + 50), (g, 1, 1)]
        added += [(g, u, v) for u, v in come] * 2 + [(g, 2, 2)]
    added.append(("brand new", 4, 3))
    new["brand new"] = [(3, 4)]
    report = stage(edge_report(frame(spark, old), heavy_degree), "report")
    more, less = spark.createDataFrame(added, PAIRS), spark.createDataFrame(removed, PAIRS)
    updated, anew = update_report(report, more, less, heavy_degree)
    want = stage(edge_report(frame(spark, new), heavy_degree), "report")
    assert rows(updated) == rows(want)
    assert anew.count() < want.count()
    runs = update_manifest(manifest(report), updated, more, less)
    means = lambda df: sorted((r.tag, r.n, r.m, round(r.summary["bf"].mean, 9)) for r in df.collect())
    assert means(runs) == means(manifest(want))


def test_a_change_reads_its_neighbourhood_only(spark):
    path = [(i, i + 1) for i in range(1000)]
    report = stage(edge_report(frame(spark, {"p": path})), "report")
    none = spark.createDataFrame([], PAIRS)
    _, anew = update_report(report, frame(spark, {"p": [(500, 502)]}), none)
    assert anew.count() <= 8
    same, anew = update_report(report, frame(spark, {"p": [(5, 4)]}), frame(spark, {"p": [(4, 5), (0, 9)]}))
    assert anew.count() == 0 and rows(same) == rows(report)


def computed(calls):
    def compute(edges):
        calls.append(sorted({r.graph_id for r in edges.select("graph_id").distinct().collect()}))
        return prepare(edges)

    return compute


def test_kept_results_follow_the_digest(spark, tmp_path):
    graphs = {"a": NAMED["fan4"], "b": NAMED["prism3"], "007": NAMED["theta3"]}
    store, calls = GraphStore(spark, str(tmp_path)), []
    first = rows(store.refresh(frame(spark, graphs), computed(calls)))
    shuffled = frame(spark, {g: [(v, u) for u, v in reversed(e)] for g, e in graphs.items()}).repartition(5)
    assert rows(store.refresh(shuffled.union(shuffled), computed(calls))) == first and calls == [["007", "a", "b"]]
    changed = graphs | {"b": NAMED["prism3"] + [(0, 40)]}
    assert rows(store.refresh(frame(spark, changed), computed(calls))) == rows(prepare(frame(spark, changed)))
    assert calls[1:] == [["b"]]
    store.refresh(frame(spark, {"a": graphs["a"]}), computed(calls), force=True)
    assert calls[2:] == [["a"]]
    assert rows(store.refresh(frame(spark, {}), computed([]))) == []


def test_digests_tell_graphs_apart(spark):
    rng = random.Random(3)
    graphs = {f"g{i}": brute.random_graph(rng, 6, 0.3) for i in range(200)}
    found = {r.graph_id: (r.digest, r.n, r.m) for r in graph_digests(frame(spark, graphs)).collect()}
    same = {}
    for g, e in graphs.items():
        same.setdefault(tuple(sorted(e)), set()).add(found[g][0])
    assert all(len(x) == 1 for x in same.values()) and len(set().union(*same.values())) == len(same)


def test_an_interrupted_run_goes_on(spark, tmp_path):
    graphs = {f"g{i}": brute.random_graph(random.Random(i), 8, 0.3) for i in range(12)}
    pairs = frame(spark, graphs)
    store, calls = GraphStore(spark, str(tmp_path)), []

    def breaks(edges):
        if len(calls) == 2:
            raise RuntimeError("lost")
        return computed(calls)(edges)

    with pytest.raises(RuntimeError, match="lost"):
        store.refresh(pairs, breaks, parts=4)
    finished = {g for c in calls for g in c}
    assert 0 < len(finished) < len(graphs)
    assert {r.graph_id for r in store.rows().select("graph_id").distinct().collect()} == finished
    # Rows without a marker, as a run leaves that ends in the middle of a graph, count for nothing.
    half = prepare(pairs).filter("u = 0").withColumn("deg_u", F.lit(99).cast("bigint"))
    half.write.partitionBy("graph_id").parquet(f"{tmp_path}/rows/run=99999999999999999999-half")
    again = []
    assert rows(store.refresh(pairs, computed(again), parts=4)) == rows(prepare(pairs))
    assert {g for c in again for g in c} == set(graphs) - finished
