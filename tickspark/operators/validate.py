"""Tick validation: one issue per rejected tick, and the tally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders (seq) per part of an instrument when the latest accepted time is carried along.
PART_BITS = 20


def finite(c: Column) -> Column:
    """Not null, not NaN and not infinite."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def quote_issue() -> Column:
    """The first thing wrong with a tick on its own; null if nothing is."""
    issue = F.when(F.col("ts_us").isNull(), "non_finite_field:timestamp")
    for name in ("bid", "ask", "mid"):
        issue = issue.when(F.col(name).isNull(), f"missing_field:{name}").when(~finite(F.col(name)), f"non_finite_field:{name}")
    middle = (F.col("bid") + F.col("ask")) * 0.5
    off = ~finite(middle) | (F.abs(middle - F.col("mid")) > 1e-6 * F.greatest(F.lit(1.0), F.abs(middle)))
    return issue.when(F.col("ask") < F.col("bid"), "negative_spread").when(off, "invalid_mid")


def audit(ticks: DataFrame) -> DataFrame:
    """ticks (instrument, seq, ts_us, bid, ask, mid, ...) with before_us, the time of the accepted tick before, and `issue`, null for accepted ticks.

    A sound tick is a regression if an earlier sound tick of its instrument is later: rejected regressions lie below
    that maximum, so the maximum over all earlier sound ticks is that over the accepted ones. It is carried in two
    levels, so that no task holds an instrument.
    """
    marked = ticks.withColumns({"__own": quote_issue(), "__part": F.shiftright("seq", PART_BITS)}).withColumn("__time", F.when(F.col("__own").isNull(), F.col("ts_us")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = marked.groupBy("instrument", "__part").agg(F.max("__time").alias("__latest"))
    carried = parts.withColumn("__carried", F.max("__latest").over(before(Window.partitionBy("instrument").orderBy("__part")))).drop("__latest")
    within = F.max("__time").over(before(Window.partitionBy("instrument", "__part").orderBy("seq")))
    both = marked.withColumn("__within", within).join(carried, ["instrument", "__part"])
    latest = F.greatest("__within", "__carried")
    issue = F.when(F.coalesce(F.col("__own").isNull() & (F.col("ts_us") < latest), F.lit(False)), "timestamp_regression").otherwise(F.col("__own"))
    return both.select(*[c for c in ticks.columns if c != "before_us"], latest.alias("before_us"), issue.alias("issue"))


def accepted(audited: DataFrame) -> DataFrame:
    """Ticks without an issue."""
    return audited.filter("issue IS NULL").drop("issue")


def tally(audited: DataFrame) -> DataFrame:
    """(instrument, total_ticks, accepted_ticks, skipped_ticks, issues MAP<STRING, BIGINT>)."""
    counts = audited.groupBy("instrument", "issue").agg(F.count("*").alias("n"))
    entries = F.collect_list(F.when(F.col("issue").isNotNull(), F.struct("issue", "n")))
    sums = counts.groupBy("instrument").agg(
        F.sum("n").alias("total_ticks"),
        F.coalesce(F.sum(F.when(F.col("issue").isNull(), F.col("n"))), F.lit(0)).alias("accepted_ticks"),
        F.map_from_entries(F.array_sort(entries)).alias("issues"),
    )
    return sums.select("instrument", "total_ticks", "accepted_ticks", (F.col("total_ticks") - F.col("accepted_ticks")).alias("skipped_ticks"), "issues")
