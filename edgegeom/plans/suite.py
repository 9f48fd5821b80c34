"""Suites of graphs: presets, tags, display names, resumable runs and their manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..columns import EDGE_KEY, GRAPH
from ..operators.stats import summarize_run
from ..sources.reports import graph_sizes
from ..staging import stage
from .report import edge_report

# Parameters of the named suites, one list entry per graph.
PRESETS = {
    "tiny": {
        "er": [[150, 0.02]], "ws": [[150, 6, 0.1]], "ba": [[150, 2]], "rg": [[150, 0.12]],
        "cycle": [[100]], "grid": [[10, 12]], "tree": [[3, 5]], "complete": [[40]],
    },
    "small": {
        "er": [[400, 0.02], [400, 0.04]], "ws": [[400, 6, 0.1], [400, 8, 0.2]],
        "ba": [[400, 2], [400, 3]], "rg": [[400, 0.09]], "cycle": [[200]], "grid": [[20, 20]],
        "tree": [[3, 6]], "complete": [[60]],
    },
    "medium": {
        "hrg": [[500, 5.0, 1.0, 0.0], [500, 5.0, 1.0, 0.5]],
        "er": [[800, 0.0100125], [1600, 0.0050031]],
        "ws": [[800, 10, 0.05], [800, 10, 0.2], [1600, 10, 0.05], [1600, 10, 0.2]],
        "ba": [[800, 2], [800, 5], [1600, 2], [1600, 5]],
        "rg": [[800, 0.056419], [1600, 0.039894]], "rreg": [[1000, 8], [2000, 8]],
        "sbm2": [[1000, 0.012018, 0.004006], [1000, 0.004002, 0.012006]],
        "cycle": [[600]], "grid": [[40, 40]], "torus": [[32, 32], [40, 40]], "tree": [[4, 6]],
        "complete": [[120]],
    },
    "paper": {
        "hrg": [[800, 5.0, 1.0, 0.0], [800, 5.0, 1.0, 0.5]],
        "er": [[800, 0.0100125], [1600, 0.0050031]],
        "ws": [[800, 10, 0.05], [800, 10, 0.2], [1600, 10, 0.05], [1600, 10, 0.2]],
        "ba": [[800, 2], [800, 5], [1600, 2], [1600, 5]],
        "rg": [[800, 0.056419], [1600, 0.039894]], "rreg": [[1000, 8], [2000, 8]],
        "sbm2": [[1000, 0.012018, 0.004006], [1000, 0.004002, 0.012006]],
        "cycle": [[600]], "grid": [[40, 40]], "torus": [[32, 32], [40, 40]], "tree": [[4, 6]],
        "complete": [[120]],
    },
    "benchmark": {"complete": [[80]]},
}

# Tag layout per family; %d takes a whole number, %s a decimal one.
TAG_LAYOUTS = {
    "er": "er_n%d_p%s",
    "ws": "ws_n%d_k%d_b%s",
    "ba": "ba_n%d_m%d",
    "rg": "rg_n%d_r%s",
    "rreg": "rreg_n%d_d%d",
    "sbm2": "sbm2_n%d_pin%s_pout%s",
    "hrg": "hrg_n%d_R%s_a%s_T%s",
    "cycle": "cycle_n%d",
    "grid": "grid_%dx%d",
    "torus": "torus_%dx%d",
    "tree": "tree_d%d_h%d",
    "complete": "complete_n%d",
}

# Display layouts per tag pattern; %1$s, %2$s .. take the matched parts.
DISPLAY_LAYOUTS = [
    (r"^er_n(\d+)_p([0-9.]+)$", "ER $n=%1$s$, $p=%2$s$"),
    (r"^ws_n(\d+)_k(\d+)_b([0-9.]+)$", r"WS $n=%1$s$, $k=%2$s$, $\beta=%3$s$"),
    (r"^ba_n(\d+)_m(\d+)$", "BA $n=%1$s$, $m=%2$s$"),
    (r"^rg_n(\d+)_r([0-9.]+)$", "RG $n=%1$s$, $r=%2$s$"),
    (r"^sbm2_n(\d+)_pin([0-9.]+)_pout([0-9.]+)$",
     r"SBM2 $n=%1$s$, $p_{\mathrm{in}}=%2$s$, $p_{\mathrm{out}}=%3$s$"),
    (r"^hrg_n(\d+)_R([0-9.]+)_a([0-9.]+)_T([0-9.]+)$",
     r"HRG $n=%1$s$, $R=%2$s$, $\alpha=%3$s$, $T=%4$s$"),
    (r"^cycle_n(\d+)$", "Cycle $C_{%1$s}$"),
    (r"^torus_(\d+)x(\d+)(?:_edges)?$", r"Torus $C_{%1$s}\times C_{%2$s}$"),
    (r"^rreg_n(\d+)_d(\d+)$", "d-Reg $n=%1$s$, $d=%2$s$"),
    (r"^grid_(\d+)x(\d+)(?:_edges)?$", r"Grid ${%1$s\times %2$s}$"),
    (r"^tree_d(\d+)_h(\d+)$", "%1$s-ary Tree ($h=%2$s$)"),
    (r"^complete_n(\d+)$", "Complete $K_{%1$s}$"),
]

# Display names of shipped graphs.
REAL_NAMES = {
    "karate": "Zachary Karate",
    "jazz": "Jazz Musicians",
    "power_grid": "US Power Grid",
    "yeast": "Yeast TF",
    "arxiv": "arXiv hep-ph citations",
}


def preset_rows(spark: SparkSession, preset: str) -> DataFrame:
    """``(family, params)`` of a named suite, one row per graph."""
    rows = [(family, [float(x) for x in params])
            for family, graphs in PRESETS[preset].items() for params in graphs]
    return spark.createDataFrame(rows, "family STRING, params ARRAY<DOUBLE>")


def resolve_suite(preset: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen graphs win per family; families without a choice keep the preset's graphs."""
    kept = preset.join(chosen.select("family").distinct(), "family", "left_anti")
    return chosen.select("family", "params").unionByName(kept.select("family", "params"))


def _decimal(x: Column) -> Column:
    """Shortest decimal text of a double: plain from 1e-4 on, like ``5.0`` or ``0.02``."""
    text = x.cast("string")
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    small = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E-(\d)$", "E-0$1")
    return F.when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16) | (x == 0), plain).otherwise(F.lower(small))


def tag_of(family: Column, params: Column) -> Column:
    """Run tag from the family and its parameters."""
    tag = F.lit(None).cast("string")
    for name, layout in TAG_LAYOUTS.items():
        kinds = [kind for kind in layout.split("%")[1:]]
        cells = [
            F.element_at(params, k + 1).cast("bigint").cast("string") if kind[0] == "d"
            else _decimal(F.element_at(params, k + 1))
            for k, kind in enumerate(kinds)
        ]
        text = F.format_string(layout.replace("%d", "%s"), *cells)
        tag = F.when((family == name) & (F.size(params) == len(cells)), text).otherwise(tag)
    return tag


def display_name(tag: Column) -> Column:
    """Readable name of a tag; an unknown tag is its own name."""
    name = tag
    for pattern, layout in DISPLAY_LAYOUTS:
        parts = []
        for k in range(pattern.count("(") - pattern.count("(?:")):
            part = F.regexp_extract(tag, pattern, k + 1)
            whole = pattern.split("(")[k + 1].startswith(r"\d")
            parts.append(part.try_cast("bigint").cast("string") if whole else part)
        name = F.when(tag.rlike(pattern), F.format_string(layout, *parts)).otherwise(name)
    real = F.regexp_extract(tag, "^real_(.+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in REAL_NAMES.items() for x in pair])
    label = F.concat(F.lit("Real: "), F.coalesce(
        F.try_element_at(known, real), F.replace(real, F.lit("_"), F.lit(" "))))
    label = F.when(real.rlike("(?i)wiki"), F.lit("Real network")).otherwise(label)
    return F.when(tag.rlike("^real_.+$"), label).otherwise(name)


def pending(graphs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of the graphs that have no report yet, by their exact ids."""
    return graphs.join(done.select(GRAPH).distinct(), GRAPH, "left_anti")


def manifest(report: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``(tag, n, m, summary)`` per graph; ``sizes`` gives n where isolated nodes count."""
    found = graph_sizes(report)
    if sizes is not None:
        given = sizes.select(GRAPH, F.col("n").alias("given_n"))
        found = found.join(given, GRAPH, "left").withColumn("n", F.coalesce("given_n", "n"))
    return found.join(summarize_run(report).select(GRAPH, "summary"), GRAPH, "left").select(
        F.col(GRAPH).alias("tag"), "n", "m", "summary")


def run_suite(graphs: DataFrame, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Report and manifest of all graphs of a table ``(graph_id, u, v)`` in one job."""
    report = stage(edge_report(graphs.select(*EDGE_KEY)), "suite-report")
    return report, manifest(report, sizes)


def resume_suite(
    graphs: DataFrame, old_reports: DataFrame, old_runs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Run only what is missing; keep old summaries and list reports no run mentions.

    ``old_reports`` are reports on disk, ``old_runs`` the old manifest. Returns the new report
    rows and the full manifest.
    """
    report, fresh = run_suite(pending(graphs, old_reports))
    on_disk = graph_sizes(old_reports)
    kept = on_disk.join(
        old_runs.select(F.col("tag").alias(GRAPH), F.col("tag").alias("old_tag"), "summary"),
        GRAPH, "left",
    ).select(F.coalesce("old_tag", GRAPH).alias("tag"), "n", "m", "summary")
    return report, fresh.unionByName(kept)
