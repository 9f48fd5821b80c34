import json
import random

import pytest
from pyspark.sql import functions as F

from edgegeom.operators.clean import node_count, with_degrees
from edgegeom.plans.report import bounds_from_forman, edge_report
from edgegeom.plans.suite import manifest, resume_suite, run_suite
from edgegeom.sources import reports as S
from edgegeom.sources.co_order import co_order_edges
from edgegeom.sources.edge_csv import read_edge_csv, read_edge_folder
from edgegeom.sources.edge_list import EdgeListReader, load_edges
from graphs import NAMED, frame


def test_edge_csv(spark, tmp_path):
    (tmp_path / "messy.csv").write_text(
        "u,v\n 1 , 2 \n2,1\n3,3\n\n # 4,5\n#6,7\n8\n9,x\n10,11,12\n5,1.5\n,4\n")
    (tmp_path / "other.csv").write_text("0,1\n")
    rows = read_edge_csv(spark, f"{tmp_path}/*.csv").collect()
    assert sorted(map(tuple, rows)) == [("messy", 1, 2), ("messy", 10, 11), ("other", 0, 1)]
    chosen = read_edge_folder(spark, str(tmp_path), ["other", "absent"])
    assert [r.n for r in node_count(chosen).collect()] == [2]


@pytest.mark.parametrize("split_bytes", [1, 7, 64, 1 << 20])
def test_edge_list_source_equals_the_csv_scan(spark, tmp_path, split_bytes):
    (tmp_path / "messy.csv").write_text("u,v\n 1 , 2 \n2,1\n3,3\n\n # 4,5\n#6,7\n8\n9,x\n10,11,12\n5,1.5\n,4\n\"6\",+7\n99999999999999999999,1\n-3,4")
    (tmp_path / "a b.csv").write_text("0,1\r\n1,2\r\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_skipped.csv").write_text("1,2\n")
    want = sorted(map(tuple, read_edge_csv(spark, [f"{tmp_path}/messy.csv", f"{tmp_path}/a b.csv"]).collect()))
    assert ("messy", -3, 4) in want and ("messy", 6, 7) in want and len(want) == 6
    for paths in (str(tmp_path), [f"file://{tmp_path}/messy.csv", f"{tmp_path}/a b.csv", f"{tmp_path}/absent.csv"]):
        assert sorted(map(tuple, load_edges(spark, paths, split_bytes).collect())) == want


def test_edge_list_reads_large_files_in_ranges(spark, tmp_path):
    rng = random.Random(2)
    edges = {(rng.randrange(10**rng.randint(1, 18)), rng.randrange(10**9)) for _ in range(5000)}
    (tmp_path / "large.csv").write_text("".join(f"{u},{v}\n" for u, v in edges))
    reader = EdgeListReader({"path": f"{tmp_path}/large.csv", "splitbytes": "1000"})
    splits = reader.partitions()
    assert len(splits) > 100
    read = [tuple(x.values()) for s in splits for b in reader.read(s) for x in b.to_pylist()]
    assert sorted(read) == sorted(("large", u, v) for u, v in edges)


def test_report_tables_join_without_a_shuffle(spark, tmp_path):
    report = edge_report(frame(spark, {"a": NAMED["prism3"], "b": NAMED["clique7"]}))
    given = report.select("graph_id", "u", "v", (F.col("bf") / 2).alias("x"))
    name = f"t{abs(hash(str(tmp_path)))}"
    one = S.save_report_table(report, f"{name}_a", f"{tmp_path}/a", 4)
    two = S.save_report_table(given, f"{name}_b", f"{tmp_path}/b", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (bounds_from_forman(one, two), one.groupBy("graph_id", "u", "v").agg(F.max("bf"))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
        want = sorted((r.u, r.v, round(r.or_lo, 9)) for r in bounds_from_forman(report, given).collect())
        assert sorted((r.u, r.v, round(r.or_lo, 9)) for r in bounds_from_forman(one, two).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}_a")
        spark.sql(f"DROP TABLE {name}_b")


def test_sizes_come_from_footers(spark, tmp_path):
    graphs = {"a_n1.5": NAMED["prism3"], "007": NAMED["clique7"]}
    S.write_report(edge_report(frame(spark, graphs)), f"{tmp_path}/parquet")
    before = spark.conf.get("spark.sql.parquet.aggregatePushdown")
    with S.footer_reads(spark):
        plan = S.footer_sizes(spark, f"{tmp_path}/parquet")._jdf.queryExecution().toString()
    assert "PushedAggregation: [MAX(v), COUNT(*)]" in plan and spark.conf.get("spark.sql.parquet.aggregatePushdown") == before
    found = {r.graph_id: (r.n, r.m) for r in S.stored_sizes(spark, f"{tmp_path}/parquet").collect()}
    assert found == {g: (1 + max(v for _, v in e), len(e)) for g, e in graphs.items()}


def test_report_round_trips(spark, tmp_path):
    report = edge_report(frame(spark, {"a_n1.5": NAMED["prism3"], "b": NAMED["clique7"]}))
    want = sorted(map(tuple, report.collect()))
    S.write_report(report, f"{tmp_path}/parquet")
    S.write_report_csv(report, f"{tmp_path}/csv")
    for df in (S.read_report(spark, f"{tmp_path}/parquet"), S.read_report_csv(spark, f"{tmp_path}/csv")):
        assert sorted(map(tuple, df.select(report.columns).collect())) == want
    kept = S.read_report(spark, f"{tmp_path}/parquet")
    assert {r.graph_id for r in S.report_for_tag(kept, "a_n1.5").collect()} == {"a_n1.5"}
    assert {r.graph_id for r in S.report_for_tag(kept, "a").collect()} == {"a_n1.5"}
    assert S.report_for_tag(kept, "zz").collect() == []


def test_ids_come_back_as_they_are(spark, tmp_path):
    big = 9007199254740993
    rows = [("007", 1, 2), ("7", 1, 3), ("a.b", 1, big), ("a_b", 0, 1), ("x/y =z", 5, 6)]
    edges = spark.createDataFrame(rows, "graph_id string, u bigint, v bigint")
    S.write_report(edges, f"{tmp_path}/parquet")
    S.write_report_csv(edges, f"{tmp_path}/csv")
    for df in (S.read_report(spark, f"{tmp_path}/parquet"), S.read_report_csv(spark, f"{tmp_path}/csv")):
        assert sorted(map(tuple, df.select("graph_id", "u", "v").collect())) == sorted(rows)
    sizes = S.graph_sizes(S.read_csv_text(spark, f"{tmp_path}/csv"))
    assert {r.graph_id: r.n for r in sizes.collect()} == {g: v + 1 for g, _, v in rows}
    kept = S.read_report(spark, f"{tmp_path}/parquet")
    assert {r.graph_id for r in S.report_for_tag(kept, "a_b").collect()} == {"a_b"}
    runs = spark.createDataFrame([("a.b",), ("7",)], "tag string")
    assert {r.graph_id for r in S.stray_reports(kept, runs).collect()} == {"007", "a_b", "x/y =z"}
    only = spark.createDataFrame([("007", 1, 2), ("7", 1, 3)], "graph_id string, u bigint, v bigint")
    S.write_report(only, f"{tmp_path}/numbers")
    assert {r.graph_id for r in S.read_report(spark, f"{tmp_path}/numbers").collect()} == {"007", "7"}


def test_edge_csv_cells_with_tabs(spark, tmp_path):
    (tmp_path / "tabs.csv").write_text("\t1,2\n3\t,4\n\t#5,6\n")
    assert sorted((r.u, r.v) for r in read_edge_csv(spark, str(tmp_path)).collect()) == [(1, 2), (3, 4)]


def test_all_pairs_of_a_large_order(spark):
    lines = [(1, i, 100 + i, 50.0) for i in range(30)] + [(2, 1, 7, 45.0), (2, 2, 8, 45.0), (2, 3, 9, 1.0)]
    table = spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double")
    for chunk_lines in (64, 5, 4):
        assert co_order_edges(table, chunk_lines=chunk_lines).count() == 435 + 3
    lots = co_order_edges(table, F.ceil(F.col("l_quantity") / 10), 4)
    assert lots.count() == 435 + 1 and {r.graph_id for r in lots.collect()} == {"5"}


def test_lines_of_small_orders_are_not_dealt_over_chunks(spark):
    table = spark.createDataFrame([(1, i, 10 * (i % 4)) for i in range(7)] + [(2, 1, 0), (2, 2, 10)], "l_orderkey bigint, l_linenumber int, l_partkey bigint")
    made = co_order_edges(table)
    assert sorted((r.u, r.v) for r in made.collect()) == [(0, 10), (0, 20), (0, 30), (10, 20), (10, 30), (20, 30)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" not in plan and "Generate" not in plan


def test_joins_sort_by_numbers_first(spark):
    """Graphs have few names: sorted by these first, rows are compared in full at almost every step."""
    lines = spark.createDataFrame([(1, i, 10 * i, "A") for i in range(7)], "l_orderkey bigint, l_linenumber int, l_partkey bigint, flag string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = co_order_edges(lines, F.col("flag"))
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (edges, with_degrees(edges))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        assert "Sort [" in plan and "Sort [graph_id" not in plan, plan


def test_a_large_order_of_many_graphs_is_dealt_within_each(spark):
    """An order is large in all graphs together, in one of them, or in none."""
    lines = [(1, i, i, str(i % 3)) for i in range(12)] + [(2, i, 50 + i, "0" if i < 9 else "1") for i in range(12)]
    table = spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, flag string")
    want = {(g, u, v) for o, _, u, g in lines for p, _, v, h in lines if o == p and g == h and u < v}
    for chunk_lines in (3, 4, 8, 11, 12):
        assert {tuple(x) for x in co_order_edges(table, F.col("flag"), chunk_lines).collect()} == want


def test_report_csv_is_tolerant(spark, tmp_path):
    (tmp_path / "r.csv").write_text("U,V,BF,note\n0,1,0.5,x\n1,2,bad,y\n,3,1,z\n")
    raw = spark.read.option("header", True).csv(str(tmp_path)).withColumn("graph_id", F.lit("g"))
    sizes = S.graph_sizes(raw.withColumnsRenamed({"U": "u", "V": "v"})).collect()
    assert [(r.n, r.m) for r in sizes] == [(3, 2)]
    rows = S.read_report_csv(spark, str(tmp_path)).collect()
    assert [(r.u, r.v, r.bf, r.note) for r in rows] == [
        (0, 1, 0.5, "x"), (1, 2, None, "y"), (None, 3, 1.0, "z")]


def test_manifest_forms(spark, tmp_path):
    _, runs = run_suite(frame(spark, {"fan1": NAMED["fan1"], "clique7": NAMED["clique7"]}))
    S.write_manifest(runs, f"{tmp_path}/lines")
    got = {r.tag: r for r in S.read_manifest(spark, f"{tmp_path}/lines").collect()}
    assert (got["clique7"].n, got["clique7"].m) == (7, 21)
    assert abs(got["fan1"].summary["bf"].mean - 1.5) < 1e-12
    assert got["fan1"].summary["n_tri"]["count"] == 3
    document = {"runs": [{"name": "old", "n": 3, "m": 2}, {"n": 1, "m": 0}], "notes": "x"}
    (tmp_path / "doc.json").write_text(json.dumps(document, indent=2))
    tags = {r.tag for r in S.read_manifest_document(spark, f"{tmp_path}/doc.json").collect()}
    assert tags == {"old", "run"}


def test_resume_keeps_old_runs(spark):
    graphs = {"tri_n1.5": NAMED["fan1"], "clique7": NAMED["clique7"], "broom2_2": NAMED["broom2_2"]}
    old_report, old_runs = run_suite(frame(spark, {"tri_n1.5": NAMED["fan1"]}))
    stray = edge_report(frame(spark, {"stray": NAMED["theta1"]}))
    fresh, runs = resume_suite(frame(spark, graphs), old_report.unionByName(stray), old_runs)
    assert {r.graph_id for r in fresh.collect()} == {"clique7", "broom2_2"}
    got = {r.tag: r for r in runs.collect()}
    assert set(got) == {"tri_n1.5", "clique7", "broom2_2", "stray"}
    assert got["stray"].summary is None and got["stray"].m == 2
    assert got["tri_n1.5"].summary["bf"].mean == 1.5


def test_manifest_takes_given_node_counts(spark):
    sizes = spark.createDataFrame([("fan1", 9)], "graph_id STRING, n BIGINT")
    report = edge_report(frame(spark, {"fan1": NAMED["fan1"]}))
    assert [r.n for r in manifest(report, sizes).collect()] == [9]
