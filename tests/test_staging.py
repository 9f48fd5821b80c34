"""What is left on disk while a job goes on: shuffles of written tables, lists that were dealt, tables that are not read again."""

import os
import pathlib
import random
import subprocess
import sys

import pytest

import brute
from edgegeom.operators import blocks as K, local as L
from edgegeom.operators.clean import prepare
from edgegeom.staging import scratch, stage
from graphs import frame

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHUFFLES = """
import os, pathlib, sys, time
from pyspark.sql import SparkSession, functions as F
from edgegeom.sources.reports import write_report, write_report_csv
from edgegeom.staging import stage
base = sys.argv[1]
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.local.dir", base + "/local").config("spark.checkpoint.dir", base + "/shared").getOrCreate())
rows = spark.range(50_000).select(F.lit("g").alias("graph_id"), (F.col("id") * 7919 % 100_003).alias("u")).repartition(2, "u")
wide = rows.withColumn("v", F.col("u") + 1)
stage(rows.groupBy("graph_id", "u").count(), "x")
write_report(wide, base + "/report")
write_report_csv(wide, base + "/csv")
end = time.time() + 10
while (left := sum(x.stat().st_size for x in pathlib.Path(base, "local").rglob("shuffle_*.data"))) and time.time() < end:
    time.sleep(0.2)
print("left", left)
"""


def test_written_tables_leave_no_shuffles(tmp_path):
    made = subprocess.run([sys.executable, "-c", SHUFFLES, str(tmp_path)], capture_output=True, text=True, timeout=300,
                          env={k: x for k, x in os.environ.items() if k != "SPARK_LOCAL_DIRS"} | {"PYTHONPATH": REPO})
    assert "left 0" in made.stdout, made.stdout + made.stderr


def test_stage_brings_the_setting_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for before in ("false", "true"):
        spark.conf.set(key, before)
        stage(spark.range(3), "x")
        assert spark.conf.get(key) == before
    spark.conf.unset(key)


@pytest.mark.parametrize("home", [1, 7, 1 << 20])
def test_waves_leave_results_only(spark, monkeypatch, home):
    """Blocks of many waves give the rows of one, whatever range of nodes a home has; lists and blocks are gone before the result is read."""
    rng = random.Random(home)
    shift = {0: 0, 1: -40, 2: 1 << 40}
    graphs = {f"g{i}": [(u + shift[i % 3], v + shift[i % 3]) for u, v in brute.random_graph(rng, rng.randint(4, 20), rng.uniform(0.1, 0.7))] for i in range(9)}
    graphs = {g: e for g, e in graphs.items() if e}
    for name, x in {"LEAST": 60, "WAVE": 1, "WAVE_PER_CORE": 0, "HOME": home, "LEAST_HOME": home}.items():
        monkeypatch.setattr(K, name, x)
    waves = []
    monkeypatch.setattr(K, "_deal", lambda starts, wave=None, f=K._deal: waves.append(wave) or f(starts, wave))
    with scratch(spark) as folder:
        degreed = prepare(frame(spark, graphs))
        made = L.local_structure(degreed)
        kept = {x.name.rsplit("-", 1)[0] for x in pathlib.Path(folder.removeprefix("file:")).iterdir() if any(x.rglob("*.parquet"))}
        assert kept == {"degreed", "seen"}
        got = {(r.graph_id, r.u, r.v): (r.deg_u, r.deg_v, r.n_tri) for r in made.collect()}
    assert len(waves) > 2
    want = {}
    for g, edges in graphs.items():
        adj = brute.adjacency(edges)
        want |= {(g, u, v): (len(adj[u]), len(adj[v]), len(adj[u] & adj[v])) for u, v in edges}
    assert got == want


@pytest.mark.parametrize("block", [K.BLOCK, 12])
def test_triangles_in_waves(spark, monkeypatch, block):
    rng = random.Random(block)
    graphs = {f"g{i}": brute.random_graph(rng, 25, 0.3) for i in range(3)}
    for name, x in {"LEAST": 12, "WAVE": 1, "WAVE_PER_CORE": 0, "HOME": 9, "LEAST_HOME": 9}.items():
        monkeypatch.setattr(K, name, x)
    waves = []
    monkeypatch.setattr(K, "_deal", lambda starts, wave=None, f=K._deal: waves.append(wave) or f(starts, wave))
    with scratch(spark) as folder:
        made = L.triangles_per_edge(prepare(frame(spark, graphs)), block)
        assert {x.name.rsplit("-", 1)[0] for x in pathlib.Path(folder.removeprefix("file:")).iterdir() if any(x.rglob("*.parquet"))} == {"degreed", "found"}
        got = {(r.graph_id, r.u, r.v): r.n_tri for r in made.collect()}
    want = {}
    for g, edges in graphs.items():
        adj = brute.adjacency(edges)
        want |= {(g, u, v): len(adj[u] & adj[v]) for u, v in edges if adj[u] & adj[v]}
    assert got == want and len(waves) > 1


def test_lists_of_exclusive_neighbors_are_not_joined(spark):
    degreed = prepare(frame(spark, {"g": [(u, u + k) for u in range(50) for k in (1, 2, 5)]}))
    assert "Join" not in L.exclusive_neighbors(degreed)._jdf.queryExecution().optimizedPlan().toString()


def test_long_walks_do_not_need_a_small_graph_again_and_again(spark):
    """Each block of a graph of few arcs would hold most of it, so there are as many as keep the cores at work."""
    rows = [(g, n, 1900.0, 3) for g in ("a", "b") for n in range(400)]
    loads = stage(spark.createDataFrame(rows, "graph_id string, node bigint, load double, k int"), "loads")
    cores = spark.sparkContext.defaultParallelism
    alone, _, many = K.in_blocks(loads, 2000)
    together, _, few = K.in_blocks(loads, 2000, loads)
    assert many > 700 and few <= 4 * cores + 1
    assert together.count() == alone.count() == 800 and together.agg({"block": "max"}).first()[0] < few
    # The arcs of own nodes of many small graphs are bounded as well.
    rows = [(f"g{i}", n, 500.0, 40) for i in range(100) for n in range(40)]
    loads = stage(spark.createDataFrame(rows, "graph_id string, node bigint, load double, k int"), "loads")
    held = K.in_blocks(loads, 2000, loads)[0].groupBy("block").count().agg({"count": "max"}).first()[0]
    assert held <= 2000 // 40 + 1
