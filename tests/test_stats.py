import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgegeom.operators import ranks, stats as Q
from edgegeom.plans.report import edge_report
from edgegeom.plans.suite import PRESETS, display_name, preset_rows, resolve_suite, tag_of
import brute
from graphs import NAMED, frame


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(5)
    return {
        "skewed": [0.0] * 400 + [rng.gauss(0, 1) for _ in range(801)],
        "ints": [float(rng.randint(0, 9)) for _ in range(57)],
        "single": [3.25],
        "flat": [2.0] * 7,
    }


@pytest.fixture(scope="module")
def values(spark, samples):
    rows = [(g, x) for g, xs in samples.items() for x in xs]
    return spark.createDataFrame(rows, "graph_id STRING, value DOUBLE").repartition(5)


def test_summary(values, samples):
    for r in Q.summarize_distribution(values, ["graph_id"]).collect():
        xs = samples[r.graph_id]
        want = [len(xs), np.mean(xs), np.std(xs), np.min(xs),
                *np.quantile(xs, [0.05, 0.25, 0.5, 0.75, 0.95]), np.max(xs)]
        assert list(r[1:]) == pytest.approx(want, abs=1e-9)


def test_profile_covers_all_ranks(values, samples):
    for g, xs in samples.items():
        rows = ranks.quantile_profile(values.filter(F.col("graph_id") == g), ["graph_id"], "value").collect()
        rows.sort(key=lambda r: r.value)
        assert [(r.value, r["count"]) for r in rows] == [(x, xs.count(x)) for x in sorted(set(xs))]
        assert rows[0].p_first == 0 and rows[-1].p_last == (1 if len(xs) > 1 else 0)


def test_histogram(values, samples):
    rows = Q.histogram(values, ["graph_id"], "value", 60).collect()
    for g, xs in samples.items():
        counts, edges = np.histogram(xs, bins=60)
        got = sorted((r for r in rows if r.graph_id == g), key=lambda r: r.bin)
        assert [r["count"] for r in got] == list(counts)
        assert [r.left for r in got] == pytest.approx(list(edges[:-1]))
        assert sum(r.density * (r.right - r.left) for r in got) == pytest.approx(1)


def test_bin_rules(values, samples):
    got = {(r.graph_id, r.rule): r.bins for r in Q.bin_counts(values, ["graph_id"], "value").collect()}
    for g in ("skewed", "flat"):
        for rule in Q.BIN_RULES:
            want = len(np.histogram_bin_edges(samples[g], bins=rule)) - 1
            assert got[g, rule] == want, (g, rule)


def test_binned_quantiles(spark):
    rng = random.Random(2)
    rows = [("g", rng.random() * 4, rng.gauss(0, 1)) for _ in range(300)] + [
        ("g", float("nan"), 1.0), ("g", 1.0, float("inf")), ("one", 2.0, 5.0), ("one", 2.0, 7.0)]
    df = spark.createDataFrame(rows, "graph_id STRING, x DOUBLE, y DOUBLE")
    got = Q.binned_quantiles(df, ["graph_id"], "x", ["y", "absent"]).collect()
    one = [r for r in got if r.graph_id == "one"]
    assert len(one) == 1 and one[0].q_mid == 6.0
    data = np.array([(x, y) for g, x, y in rows if g == "g" and np.isfinite(x) and np.isfinite(y)])
    edges = np.linspace(data[:, 0].min(), data[:, 0].max(), 29)
    where = np.clip(np.digitize(data[:, 0], edges) - 1, 0, 27)
    for r in (r for r in got if r.graph_id == "g"):
        inside = data[where == r.bin, 1]
        if len(inside):
            assert [r.q_low, r.q_mid, r.q_high] == pytest.approx(list(np.quantile(inside, [0.1, 0.5, 0.9])))
        else:
            assert np.isnan(r.q_mid)
        assert r.center == pytest.approx((edges[r.bin] + edges[r.bin + 1]) / 2)


def test_run_summary(spark):
    report = edge_report(frame(spark, {k: NAMED[k] for k in ("prism3", "clique7", "broom2_2")}))
    rows = {r.graph_id: r for r in Q.summarize_run(report).collect()}
    for r in rows.values():
        assert [r.or_in_band, r.bf_in_band, r.below_transport, r.below_linear] == [1, 1, 1, 1]
        assert set(r.summary) == set(Q.RUN_METRICS)
    values = [x["or_lazy"] for x in brute.edge_rows(NAMED["broom2_2"]).values()]
    assert rows["broom2_2"].summary["or_lazy"].mean == pytest.approx(sum(values) / len(values))


def test_sample_is_fixed_by_its_seed(spark):
    edges = frame(spark, {"g": [(i, i + 1) for i in range(500)]})
    first = set(map(tuple, Q.seeded_sample(edges, 50, 3).collect()))
    again = set(map(tuple, Q.seeded_sample(edges.repartition(7), 50, 3).collect()))
    other = set(map(tuple, Q.seeded_sample(edges, 50, 4).collect()))
    assert len(first) == 50 and first == again and first != other


@pytest.mark.parametrize("family,params,tag,name", [
    ("er", [800, 0.0100125], "er_n800_p0.0100125", "ER $n=800$, $p=0.0100125$"),
    ("er", [9, 0.00005], "er_n9_p5e-05", "er_n9_p5e-05"),
    ("ws", [400, 6, 0.1], "ws_n400_k6_b0.1", r"WS $n=400$, $k=6$, $\beta=0.1$"),
    ("hrg", [500, 5.0, 1.0, 0.5], "hrg_n500_R5.0_a1.0_T0.5", r"HRG $n=500$, $R=5.0$, $\alpha=1.0$, $T=0.5$"),
    ("grid", [10, 12], "grid_10x12", r"Grid ${10\times 12}$"),
    ("sbm2", [10, 0.5, 0.25], "sbm2_n10_pin0.5_pout0.25",
     r"SBM2 $n=10$, $p_{\mathrm{in}}=0.5$, $p_{\mathrm{out}}=0.25$"),
    ("tree", [3, 5], "tree_d3_h5", "3-ary Tree ($h=5$)"),
])
def test_tags_and_names(spark, family, params, tag, name):
    df = spark.createDataFrame([(family, [float(x) for x in params])], "family STRING, params ARRAY<DOUBLE>")
    row = df.select(tag_of(F.col("family"), F.col("params")).alias("tag")).select(
        "tag", display_name(F.col("tag")).alias("name")).first()
    assert (row.tag, row.name) == (tag, name)


def test_real_names(spark):
    tags = {"real_karate": "Real: Zachary Karate", "real_my_net": "Real: my net",
            "real_simpleWiki": "Real network", "torus_4x5_edges": r"Torus $C_{4}\times C_{5}$",
            "odd": "odd"}
    df = spark.createDataFrame([(t,) for t in tags], "tag STRING")
    got = {r.tag: r.name for r in df.select("tag", display_name(F.col("tag")).alias("name")).collect()}
    assert got == tags


def test_suite_resolution(spark):
    chosen = spark.createDataFrame([("er", [5.0, 0.5])], "family STRING, params ARRAY<DOUBLE>")
    rows = resolve_suite(preset_rows(spark, "tiny"), chosen).collect()
    assert [r.params for r in rows if r.family == "er"] == [[5.0, 0.5]]
    assert {r.family for r in rows} == set(PRESETS["tiny"])


def test_merged_sketches(spark):
    """Parts of one distribution merge to its moments, and to its quantiles within the stated rank error."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=40_000), rng.integers(0, 5, 20_000), [np.pi] * 15_000])
    rows = spark.createDataFrame([(int(i % 37), float(v)) for i, v in enumerate(x)] + [(99, None)], "part int, value double")
    whole = Q.merge_sketches(Q.sketch_metrics(rows, ["part"]).withColumn("metric", F.lit("m")), ["metric"])
    r = Q.summarize_sketches(whole, ["metric"]).first()
    assert r["count"] == len(x)
    assert (r["mean"], r["std"], r["min"], r["max"]) == (pytest.approx(x.mean()), pytest.approx(x.std()), x.min(), x.max())
    for name, p in Q.SUMMARY_QUANTILES.items():
        below, upto = (x < r[name]).mean(), (x <= r[name]).mean()
        assert below - 2 * Q.sketch_rank_error() <= p <= upto + 2 * Q.sketch_rank_error()
    assert Q.sketch_rank_error() < 0.005
    exact = Q.summarize_sketches(Q.sketch_metrics(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, value double"), ["g"]), ["g"]).first()
    assert (exact["count"], exact["min"], exact["max"]) == (2, 1.0, 2.0)
