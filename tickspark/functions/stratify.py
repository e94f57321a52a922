"""Stratification: outcomes by bins of a metric, several metrics and binning modes in one plan."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tickspark.operators.validate import finite

log = logging.getLogger(__name__)
MODES = ("fixed", "fd", "scott", "sigma", "nbins")
#: Least and most bins; half width of the confidence interval in standard errors.
LEAST_BINS, MOST_BINS, Z = 20, 400, 1.96


@dataclass(frozen=True)
class Binning:
    """How edges are chosen. clip: quantiles between which the edges lie."""

    mode: str = "scott"
    nbins: int | None = None
    width: float | None = None
    sigma_width: float = 0.25
    sigma_span: float = 4.0
    clip: tuple[float, float] = (0.001, 0.999)
    min_count: int = 100
    merge_to_min_count: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"Unknown mode: {self.mode}")


@dataclass(frozen=True)
class Spread1D:
    """Figures of a metric's clipped values."""

    n: int
    low: float
    high: float
    mean: float
    std: float
    iqr: float


def linspace(low: float, high: float, bins: int) -> list[float]:
    """bins + 1 edges from low to high."""
    step = (high - low) / bins
    return [low + k * step for k in range(bins)] + [high]


def edges(s: Spread1D, b: Binning) -> list[float]:
    """Edges by the binning's mode; a metric without span has the edges [v, v]."""
    span = s.high - s.low
    if span == 0:
        return [s.low, s.high]
    low, high = s.low, s.high
    if b.mode == "nbins":
        wanted = float(b.nbins or 100)
    elif b.mode == "sigma":
        if not s.std > 0:
            return [s.low, s.high]
        low, high = s.mean - b.sigma_span * s.std, s.mean + b.sigma_span * s.std
        wanted = math.ceil((high - low) / (s.std * b.sigma_width))
    else:
        if b.mode == "fixed" and b.width is not None:
            width = b.width
        elif b.mode == "fd":
            width = 2 * max(s.iqr, 2.220446049250313e-16) / s.n ** (1 / 3)
        else:
            width = max(3.5 * s.std / s.n ** (1 / 3), span / 200)
        wanted = math.ceil(span / width)
    return linspace(low, high, int(min(max(wanted, LEAST_BINS), MOST_BINS)))


def merged(cuts: Sequence[float], counts: Sequence[int], min_count: int) -> list[float]:
    """Edges after joining neighbouring bins, left to right, until each holds min_count; the last may hold fewer."""
    out, held = [cuts[0]], 0
    for edge, n in zip(cuts[1:], counts, strict=True):
        held += n
        if held >= min_count:
            out.append(edge)
            held = 0
    return out if out[-1] == cuts[-1] else [*out, cuts[-1]]


def shown_edges(cuts: Sequence[float]) -> list[tuple[float, float]]:
    """(left, right) of each bin as interval labels show them: rounded to as few digits as keep the edges apart, the first left edge lowered by one."""

    def rounded(x: float, digits: int) -> float:
        if not math.isfinite(x) or x == 0:
            return x
        fraction, whole = math.modf(x)
        return round(x, digits if whole else -math.floor(math.log10(abs(fraction))) - 1 + digits)

    digits = next((d for d in range(3, 20) if len({rounded(x, d) for x in cuts}) == len(cuts)), 3)
    r = [rounded(x, digits) for x in cuts]
    return [(r[0] - 10.0**-digits, r[1]), *zip(r[1:-1], r[2:], strict=True)]


def bin_of(x: Column, cuts: Column) -> Column:
    """Bin (from 0) of x among ascending edges: (edge k, edge k+1], the lowest edge included; null outside."""
    below = F.size(F.filter(cuts, lambda e: e < x))
    return F.when((x < cuts[0]) | (x > F.element_at(cuts, -1)), None).when(x == cuts[0], 0).otherwise(below - 1)


def even_bin_of(x: Column, cuts: Column) -> Column:
    """bin_of() for edges of equal width: computed, then set right against the edges on either side."""
    top = F.size(cuts) - 2
    guess = F.least(top, F.greatest(F.lit(0), F.floor((x - cuts[0]) / (cuts[1] - cuts[0])).cast("int")))
    fixed = F.when((x <= cuts[guess]) & (guess > 0), guess - 1).when((x > cuts[guess + 1]) & (guess < top), guess + 1).otherwise(guess)
    return F.when((x < cuts[0]) | (x > F.element_at(cuts, -1)), None).otherwise(fixed)


def metric_columns(df: DataFrame, prefixes: Sequence[str]) -> list[str]:
    """Numeric columns of the metrics with these names."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and any(f.name.startswith(f"{p}.") for p in prefixes)]


def _long(trades: DataFrame, metrics: Sequence[str], value_col: str) -> DataFrame:
    """(metric, x, y) with finite x and y."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("x")) for m in metrics]))
    rows = trades.select(pairs.alias("p"), F.col(value_col).cast("double").alias("y")).select("p.*", "y")
    return rows.filter(finite(F.col("x")) & finite(F.col("y")))


def figures(rows: DataFrame, clip: tuple[float, float]) -> dict[str, Spread1D]:
    """Per metric: two aggregations, one result row per metric."""
    q = rows.groupBy("metric").agg(F.percentile("x", F.array(F.lit(clip[0]), F.lit(clip[1]))).alias("q"))
    inside = rows.join(q, "metric").filter(F.col("x").between(F.col("q")[0], F.col("q")[1]))
    stats = inside.groupBy("metric").agg(
        F.count("*").alias("n"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("iq"),
    )
    return {r.metric: Spread1D(r.n, r.low, r.high, r.mean, r.std if r.std is not None else math.nan, r.iq[1] - r.iq[0]) for r in stats.collect()}


def stratify(trades: DataFrame, metrics: Sequence[str], binnings: Sequence[Binning] = (Binning(),), value_col: str = "pnl_pips") -> DataFrame:
    """One row per metric, mode and occupied bin: count, mean, deviation, median, win rate, edges and 95 % interval.

    Metrics that the table lacks are skipped; a metric without finite values or without span is logged and skipped.
    The edge tables that go to all tasks hold at most 401 numbers per metric and mode. bin_left and bin_right are
    exact edges, *_label those that interval labels show; bin_center and bin_width follow the labels.
    """
    spark = trades.sparkSession
    present = [m for m in metrics if m in trades.columns]
    schema = "metric string, mode string, cuts array<double>, even boolean, labels array<struct<left:double,right:double>>, min_count int"
    rows = _long(trades, present, value_col) if present else None
    plans = []
    by_clip = {clip: figures(rows, clip) if rows is not None else {} for clip in {b.clip for b in binnings}}  # modes share them
    for b in binnings:
        found = by_clip[b.clip]
        for m in present:
            if m not in found:
                log.warning("no finite data for metric %s", m)
                continue
            cuts = edges(found[m], b)
            if len(set(cuts)) != len(cuts):
                log.warning("metric %s has no span in mode %s", m, b.mode)
                continue
            plans.append([m, b, cuts])
    tight = [p for p in plans if p[1].merge_to_min_count]
    if tight:
        counted = _counts(rows, [(p[0], i, p[2]) for i, p in enumerate(tight)])
        for i, p in enumerate(tight):
            p[2] = merged(p[2], [counted.get((p[0], i, k), 0) for k in range(len(p[2]) - 1)], p[1].min_count)
    table = [(m, b.mode, cuts, not b.merge_to_min_count, shown_edges(cuts), b.min_count) for m, b, cuts in plans]
    cuts = spark.createDataFrame(table, schema)
    if rows is None:
        rows = spark.createDataFrame([], "metric string, x double, y double")
    binned = rows.join(F.broadcast(cuts), "metric").withColumn("bin", F.when(F.col("even"), even_bin_of(F.col("x"), F.col("cuts"))).otherwise(bin_of(F.col("x"), F.col("cuts")))).filter("bin IS NOT NULL")
    summed = binned.groupBy("metric", "mode", "bin").agg(
        F.count("*").alias("count"), F.avg("y").alias("avg_pnl"), F.stddev_samp("y").alias("std_pnl"), F.percentile("y", F.lit(0.5)).alias("median_pnl"), F.avg((F.col("y") > 0).cast("double")).alias("win_rate")
    )
    out = summed.join(F.broadcast(cuts), ["metric", "mode"])
    left, right, se = F.col("labels")[F.col("bin")]["left"], F.col("labels")[F.col("bin")]["right"], F.col("std_pnl") / F.sqrt(F.greatest(F.col("count"), F.lit(1)))
    return out.select(
        "metric", "mode", "bin", F.col("cuts")[F.col("bin")].alias("bin_left"), F.col("cuts")[F.col("bin") + 1].alias("bin_right"), left.alias("bin_left_label"), right.alias("bin_right_label"),
        (0.5 * (left + right)).alias("bin_center"), (right - left).alias("bin_width"), "count", "avg_pnl", "std_pnl", "median_pnl", "win_rate", se.alias("se"),
        (F.col("avg_pnl") - Z * se).alias("ev_lo"), (F.col("avg_pnl") + Z * se).alias("ev_hi"), "min_count",
    )


def _counts(rows: DataFrame, wanted: list[tuple[str, int, list[float]]]) -> dict[tuple[str, int, int], int]:
    """Rows per bin for merging: bins [a, b), the last one closed. At most 400 counts per metric and binning."""
    cuts = rows.sparkSession.createDataFrame(wanted, "metric string, i int, cuts array<double>")
    x, c = F.col("x"), F.col("cuts")
    nth = F.least(F.size(F.filter(c, lambda e: e <= x)) - 1, F.size(c) - 2)
    inside = rows.join(F.broadcast(cuts), "metric").filter((x >= c[0]) & (x <= F.element_at(c, -1)))
    return {(r.metric, r.i, r.k): r.n for r in inside.groupBy("metric", "i", nth.alias("k")).agg(F.count("*").alias("n")).collect()}


def plot_rows(summary: DataFrame, most_width: float | None = 10.0, limits: tuple[float, float] | None = (0.005, 0.995), smoothing: int = 5) -> DataFrame:
    """The bins that a plot shows: enough trades, not far wider than the median; with the centred mean of `smoothing` bins and the x limits."""
    shown = summary.filter(F.col("count") >= F.col("min_count"))
    every = Window.partitionBy("metric", "mode")
    if most_width is not None:
        shown = shown.withColumn("__w", F.percentile("bin_width", F.lit(0.5)).over(every)).filter(F.col("bin_width") <= most_width * F.col("__w")).drop("__w")
    half = smoothing // 2
    around = every.orderBy("bin").rowsBetween(-half, half)
    out = shown.withColumn("smoothed", F.when(F.count("*").over(around) == 2 * half + 1, F.avg("avg_pnl").over(around)))
    if limits is not None:
        for name, q in zip(("x_low", "x_high"), limits, strict=True):
            out = out.withColumn(name, F.percentile("bin_center", F.lit(q)).over(every))
    return out


def overall(trades: DataFrame, metrics: Sequence[str] = (), value_col: str = "pnl_pips") -> DataFrame:
    """One row: trades, expectancy, win rate, and per metric the number of nulls."""
    nulls = [F.count_if(F.col(f"`{m}`").isNull() | F.isnan(F.col(f"`{m}`").cast("double"))).alias(f"{m}.nulls") for m in metrics if m in trades.columns]
    return trades.agg(F.count("*").alias("trades"), F.avg(value_col).alias("expectancy"), F.avg((F.col(value_col) > 0).cast("double")).alias("win_rate"), *nulls)


def sweep_bins(trades: DataFrame, metric: str, bins: int = 300, value_col: str = "pnl_pips") -> DataFrame:
    """Equal-width bins over the whole range: (bin_center, count, win_rate, avg_pnl, std_pnl), bins with two trades or more."""
    x = F.col(f"`{metric}`").cast("double")
    rows = trades.select(x.alias("x"), F.col(value_col).alias("y")).filter(finite(F.col("x")))
    span = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    joined = rows.join(F.broadcast(span)).filter(F.col("high") > F.col("low"))  # one row
    nth = F.greatest(F.ceil((F.col("x") - F.col("low")) / width) - 1, F.lit(0))
    grouped = joined.groupBy(F.least(nth, F.lit(bins - 1)).cast("int").alias("bin"), F.col("low"), width.alias("width"))
    out = grouped.agg(F.count("*").alias("count"), F.avg((F.col("y") > 0).cast("double")).alias("win_rate"), F.avg("y").alias("avg_pnl"), F.stddev_samp("y").alias("std_pnl")).filter("std_pnl IS NOT NULL")
    return out.select("bin", (F.col("low") + (F.col("bin") + 0.5) * F.col("width")).alias("bin_center"), "count", "win_rate", "avg_pnl", "std_pnl")
