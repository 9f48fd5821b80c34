"""Distribution summaries and binned views of a per-edge report."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import EDGE_KEY, GRAPH
from ..functions.draws import uniform
from ..staging import stage
from .ranks import quantile_columns, quantiles

#: Quantiles of a distribution summary (fixed values).
SUMMARY_QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
#: Metrics summarised for a run (fixed choice).
RUN_METRICS = ["or_lazy", "bf", "env_slack", "theta_slack", "n_tri", "n_quad"]
#: Slack of the coverage tests (fixed value).
COVERAGE_EPS = 1e-9
STATISTICS = ["count", "mean", "std", "min", "q05", "q25", "median", "q75", "q95", "max"]


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that the table really has."""
    return [c for c in wanted if c in df.columns]


def long_metrics(df: DataFrame, metrics: list[str], keep: list[str] = (GRAPH,)) -> DataFrame:
    """``(keep.., metric, value)``; metrics the table lacks are left out."""
    present = available(df, list(metrics))
    typed = df.select(*keep, *[F.col(m).cast("double").alias(m) for m in present])
    return typed.unpivot(list(keep), present, "metric", "value")


def with_slack(report: DataFrame) -> DataFrame:
    """Distance of the lazy curvature from both envelopes."""
    return report.withColumns({
        "env_slack": F.col("env_transport") - F.col("or_lazy"),
        "theta_slack": F.col("env_at_tri") - F.col("or_lazy"),
    })


def summarize_distribution(values: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Count, mean, population deviation, extremes and quantiles per group."""
    x = F.col(value)
    moments = values.groupBy(*group).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    points = quantile_columns(values, group, value, SUMMARY_QUANTILES)
    return moments.join(points, group, "left").select(*group, *STATISTICS)


#: Size of a quantile sketch.
SKETCH_K = 800
MOMENTS = ["count", "mean", "m2", "min", "max"]


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """Largest error of a rank, as a share of all rows, that 99 in 100 sketches keep (fixed values of the sketch)."""
    return 2.296 / k**0.9723


def sketch_metrics(values: DataFrame, group: list[str], value: str = "value", k: int = SKETCH_K) -> DataFrame:
    """``(group.., count, mean, m2, min, max, sketch)``: exact moments and a quantile sketch of bounded size.

    Rows are stored with a run's manifest; those of several graphs merge without their edges.
    """
    x = F.col(value)
    return values.groupBy(*group).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, group: list[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of larger groups from those of their parts; ``group`` names the columns that stay."""
    n, mean = F.col("count"), F.col("mean")
    total = F.sum(n)
    # Squares about the parts' means, and of these about the whole mean by one pass over few rows a group.
    return sketches.groupBy(*group).agg(
        total.alias("count"), (F.sum(n * mean) / total).alias("mean"),
        (F.sum("m2") + F.greatest(F.lit(0.0), F.sum(n * mean * mean) - F.sum(n * mean) * F.sum(n * mean) / total)).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
    )


def summarize_sketches(sketches: DataFrame, group: list[str]) -> DataFrame:
    """The columns of ``summarize_distribution``, quantiles within :func:`sketch_rank_error` of their rank."""
    points = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in SUMMARY_QUANTILES.items()]
    return sketches.select(*group, "count", "mean", F.sqrt(F.col("m2") / F.col("count")).alias("std"), "min", "max", *points).select(*group, *STATISTICS)


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def coverage(report: DataFrame, eps: float = COVERAGE_EPS) -> DataFrame:
    """Per graph, the share of edges inside each band and below each envelope."""
    lazy, bf = F.col("or_lazy"), F.col("bf")
    return report.groupBy(GRAPH).agg(
        _share((lazy >= F.col("or_lo") - eps) & (lazy <= F.col("or_hi") + eps)).alias("or_in_band"),
        _share((bf >= F.col("bf_lo") - eps) & (bf <= F.col("bf_hi") + eps)).alias("bf_in_band"),
        _share(lazy <= F.col("env_transport") + eps).alias("below_transport"),
        _share(lazy <= F.col("env_at_tri") + eps).alias("below_linear"),
    )


def band_widths(report: DataFrame) -> DataFrame:
    """Per graph, the mean width of both transfer bands."""
    return report.groupBy(GRAPH).agg(
        F.avg(F.col("or_hi") - F.col("or_lo")).alias("or_width"),
        F.avg(F.col("bf_hi") - F.col("bf_lo")).alias("bf_width"),
    )


def summarize_run(report: DataFrame) -> DataFrame:
    """One row per graph: a map of metric summaries, coverage shares and mean band widths."""
    values = long_metrics(with_slack(report), RUN_METRICS)
    per_metric = summarize_distribution(values, [GRAPH, "metric"])
    summary = per_metric.groupBy(GRAPH).agg(
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("metric", F.struct(*STATISTICS))))).alias("summary")
    )
    return summary.join(coverage(report), GRAPH).join(band_widths(report), GRAPH)


def _ranges(values: DataFrame, group: list[str], value: str) -> DataFrame:
    return values.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                                      F.count(value).alias("n"))


def _bin_of(x: Column, lo: Column, width: Column, bins) -> Column:
    """Index of the bin holding x among edges ``lo + k * width``; the last edge is inside."""
    last = (bins if isinstance(bins, Column) else F.lit(bins)) - 1
    guess = F.floor((x - lo) / width)
    below = F.when(x < lo + guess * width, 1).otherwise(0)
    above = F.when(x >= lo + (guess + 1) * width, 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(last, guess - below + above)).cast("int")


def histogram(values: DataFrame, group: list[str], value: str, bins: int) -> DataFrame:
    """``(group.., bin, left, right, count, density)`` with equal bins over each group's range.

    Empty bins are listed; a group with a single value gets a range of one around it.
    """
    ranges = (
        _ranges(values, group, value)
        .withColumn("flat", F.col("lo") == F.col("hi"))
        .withColumn("lo", F.when(F.col("flat"), F.col("lo") - 0.5).otherwise(F.col("lo")))
        .withColumn("hi", F.when(F.col("flat"), F.col("hi") + 0.5).otherwise(F.col("hi")))
        .withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    )
    counted = (
        values.join(ranges, group)
        .withColumn("bin", _bin_of(F.col(value), F.col("lo"), F.col("width"), bins))
        .groupBy(*group, "bin").agg(F.count(value).alias("count"))
    )
    slots = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    left = F.col("lo") + F.col("bin") * F.col("width")
    count = F.coalesce("count", F.lit(0).cast("long"))
    return slots.join(counted, [*group, "bin"], "left").select(
        *group, "bin", left.alias("left"), (left + F.col("width")).alias("right"),
        count.alias("count"), (count / (F.col("n") * F.col("width"))).alias("density"),
    )


def histogram_2d(values: DataFrame, group: list[str], x: str, y: str, bins: int = 30) -> DataFrame:
    """``(group.., bin_x, bin_y, count)`` of the non-empty cells of a bins x bins grid."""
    ranges = values.groupBy(*group).agg(
        F.min(x).alias("lo_x"), F.max(x).alias("hi_x"), F.min(y).alias("lo_y"), F.max(y).alias("hi_y")
    )

    def cell(name: str) -> Column:
        lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        flat = lo == hi
        start = F.when(flat, lo - 0.5).otherwise(lo)
        width = F.when(flat, F.lit(1.0)).otherwise(hi - lo) / bins
        return _bin_of(F.col({"x": x, "y": y}[name]), start, width, bins)

    return (
        values.join(ranges, group)
        .groupBy(*group, cell("x").alias("bin_x"), cell("y").alias("bin_y"))
        .agg(F.count("*").alias("count"))
    )


def binned_quantiles(
    values: DataFrame, group: list[str], x: str, ys: list[str], bins: int = 28,
    probs: tuple[float, float, float] = (0.1, 0.5, 0.9),
) -> DataFrame:
    """``(group.., series, bin, center, q_low, q_mid, q_high)`` of each y over equal bins of x.

    Rows with a non-finite x or y are dropped, empty bins hold NaN, and a group with one x value
    has one bin.
    """
    rows = long_metrics(values, ys, [*group, x]).withColumnRenamed("metric", "series")

    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))

    series = [*group, "series"]
    rows = rows.withColumn(x, F.col(x).cast("double")).filter(finite(x) & finite("value"))
    flat = F.col("lo") == F.col("hi")
    ranges = (
        _ranges(rows, series, x)
        .withColumn("bins", F.when(flat, 1).otherwise(bins))
        .withColumn("width", F.when(flat, F.lit(1e-6)).otherwise((F.col("hi") - F.col("lo")) / bins))
    )
    binned = rows.join(ranges, series).withColumn(
        "bin", _bin_of(F.col(x), F.col("lo"), F.col("width"), F.col("bins")))
    names = dict(zip(("q_low", "q_mid", "q_high"), probs))
    points = quantile_columns(binned, [*series, "bin"], "value", names)
    slots = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    nan = F.lit(float("nan"))
    return slots.join(points, [*series, "bin"], "left").select(
        *series, "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("center"),
        *[F.coalesce(name, nan).alias(name) for name in names],
    )


def ribbon(report: DataFrame, bins: int = 28) -> DataFrame:
    """Observed lazy curvature and its transfer band over bins of Balanced Forman."""
    return binned_quantiles(report, [GRAPH], "bf", available(report, ["or_lazy", "or_lo", "or_hi"]), bins)


BIN_RULES = ["sqrt", "sturges", "rice", "scott", "fd", "doane", "auto", "stone"]


def bin_counts(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """``(group.., rule, bins)`` for the usual bin-count rules.

    ``stone`` tries every count up to ``max(100, sqrt(n))``; it works on counted distinct values
    and combines them before the shuffle.
    """
    values = stage(values.select(*group, F.col(value).cast("double").alias(value)), "bin-rules")
    x = F.col(value)
    base = values.groupBy(*group).agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"),
    )
    base = base.join(quantile_columns(values, group, value, {"q1": 0.25, "q3": 0.75}), group)
    n, span = F.col("n").cast("double"), F.col("hi") - F.col("lo")
    root3 = F.pow(n, F.lit(1.0 / 3.0))
    sturges = span / (F.log2(n) + 1.0)
    root = span / F.sqrt(n)
    fd = F.lit(2.0) * (F.col("q3") - F.col("q1")) / root3
    spread = F.sqrt(F.lit(6.0) * (n - 2) / ((n + 1) * (n + 3)))
    doane = F.when(
        (n > 2) & (F.col("sd") > 0),
        span / (F.lit(1.0) + F.log2(n) + F.log2(F.lit(1.0) + F.abs(F.col("skew")) / spread)),
    ).otherwise(0.0)
    widths = {
        "sqrt": root,
        "sturges": sturges,
        "rice": span / (F.lit(2.0) * root3),
        "scott": F.col("sd") * (24.0 * math.sqrt(math.pi)) ** (1.0 / 3.0) / root3,
        "fd": fd,
        "doane": doane,
        "auto": F.least(F.greatest(fd, root / 2.0), sturges),
    }
    count = F.when(F.col("width") > 0, F.ceil(F.col("span") / F.col("width"))).otherwise(1)
    closed = base.select(
        *group, span.alias("span"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), w.alias("width"))
                           for k, w in widths.items()])),
    ).select(*group, "rule", count.cast("long").alias("bins"))
    return closed.unionByName(_stone(values, base, group, value))


def _stone(values: DataFrame, base: DataFrame, group: list[str], value: str) -> DataFrame:
    limit = F.greatest(F.lit(100), F.floor(F.sqrt("n"))).cast("int")
    ranges = base.filter(F.col("hi") > F.col("lo")).select(*group, "n", "lo", "hi", limit.alias("limit"))
    distinct = values.groupBy(*group, value).agg(F.count("*").alias("copies"))
    tried = distinct.join(ranges, group).withColumn(
        "bins", F.explode(F.sequence(F.lit(1), F.col("limit"))))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    filled = (
        tried.withColumn("bin", _bin_of(F.col(value), F.col("lo"), width, F.col("bins")))
        .groupBy(*group, "n", "lo", "hi", "bins", "bin").agg(F.sum("copies").alias("held"))
    )
    share = F.col("held") / F.col("n")
    losses = filled.groupBy(*group, "n", "lo", "hi", "bins").agg(
        F.sum(share * share).alias("squares")
    ).select(*group, "bins", (
        (F.lit(2.0) - (F.col("n") + 1) * F.col("squares")) * F.col("bins") / (F.col("hi") - F.col("lo"))
    ).alias("loss"))
    best = losses.groupBy(*group).agg(F.min(F.struct("loss", "bins"))["bins"].cast("long").alias("best"))
    return base.select(*group).join(best, group, "left").select(
        *group, F.lit("stone").alias("rule"), F.coalesce("best", F.lit(1).cast("long")).alias("bins")
    )


def seeded_sample(df: DataFrame, size: int = 25_000, seed: int = 0, key: list[str] = EDGE_KEY) -> DataFrame:
    """``size`` rows without replacement; the same rows for the same seed and keys."""
    draw = uniform(seed, *[F.col(c) for c in key])
    return df.withColumn("draw", draw).orderBy("draw", *key).limit(size).drop("draw")


def quantile_grid(values: DataFrame, group: list[str], value: str, steps: int) -> DataFrame:
    """Quantiles on an even grid of ``steps + 1`` points."""
    return quantiles(values, group, value, [k / steps for k in range(steps + 1)])
