"""Performance of a trade ledger, for all pairs in one plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: trading days per year.
TRADING_DAYS = 252


def ordered(trades: DataFrame, by: str = "pair") -> DataFrame:
    """trades with n (place by exit time), cumulative_pnl, running_peak and drawdown.

    The peak starts at the first cumulative value, not at zero: an initial loss is no drawdown.
    """
    tie = [c for c in ("signal_seq", "entry_time") if c in trades.columns]
    w = Window.partitionBy(by).orderBy("exit_time", *tie)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumns({"n": F.row_number().over(w), "cumulative_pnl": F.sum("pnl_pips").over(so_far)})
    return out.withColumn("running_peak", F.max("cumulative_pnl").over(so_far)).withColumn("drawdown", F.col("cumulative_pnl") - F.col("running_peak"))


def equity_curve(trades: DataFrame, by: str = "pair") -> DataFrame:
    """(pair, exit_time, pnl_pips, cumulative_pnl, drawdown) in order: what a plot of the equity needs."""
    return ordered(trades, by).select(by, "n", "exit_time", "pnl_pips", "cumulative_pnl", "drawdown")


def sharpe(x: Column, scale: Column) -> Column:
    """mean / sample deviation * scale; NaN where the deviation is 0 or unknown."""
    std = F.stddev_samp(x)
    return F.when(std.isNull() | F.isnan(std) | (std == 0), F.lit(math.nan)).otherwise(F.avg(x) / std * scale)


def daily_returns(curve: DataFrame, by: str = "pair") -> DataFrame:
    """(pair, sampled_days, daily_return_mean, daily_return_std, daily_sharpe) of the equity at the end of each calendar day.

    A day without an exit repeats the day before, so it adds a return of 0: such days are counted, not generated.
    """
    ends = curve.groupBy(by, F.to_date("exit_time").alias("day")).agg(F.max_by("cumulative_pnl", F.struct("exit_time", "n")).alias("equity"))
    moved = ends.withColumn("move", F.col("equity") - F.lag("equity").over(Window.partitionBy(by).orderBy("day")))
    sums = moved.groupBy(by).agg((F.date_diff(F.max("day"), F.min("day"))).cast("long").alias("sampled_days"), F.sum("move").alias("total"), F.count("move").alias("seen"), F.avg("move").alias("m"), F.var_pop("move").alias("v"))
    days = F.col("sampled_days")
    mean = F.when(days > 0, F.col("total") / days)
    # squares about the mean over all days: those seen, and the days that did not move
    squares = F.col("seen") * (F.col("v") + (F.col("m") - mean) * (F.col("m") - mean)) + (days - F.col("seen")) * mean * mean
    std = F.when(days > 1, F.sqrt(squares / (days - 1)))
    ratio = F.when(std > 0, mean / std * math.sqrt(TRADING_DAYS))
    nan = lambda c: F.coalesce(c, F.lit(math.nan))
    return sums.select(by, "sampled_days", nan(mean).alias("daily_return_mean"), nan(std).alias("daily_return_std"), nan(ratio).alias("daily_sharpe"))


def drawdowns(curve: DataFrame, by: str = "pair") -> DataFrame:
    """(pair, max_drawdown_pips, max_drawdown_seconds): the deepest drawdown and the time from its first peak to its first trough."""
    trough = curve.groupBy(by).agg(F.min("drawdown").alias("max_drawdown_pips"), F.min_by("exit_time", F.struct("drawdown", "n")).alias("trough"))
    before = curve.join(trough, by).filter(F.col("exit_time") <= F.col("trough"))
    peak = before.groupBy(by, "max_drawdown_pips", "trough").agg(F.min_by("exit_time", F.struct(-F.col("cumulative_pnl"), F.col("n"))).alias("peak"))
    return peak.select(by, "max_drawdown_pips", ((F.unix_micros("trough") - F.unix_micros("peak")) / 1e6).alias("max_drawdown_seconds"))


def performance(trades: DataFrame, by: str = "pair") -> DataFrame:
    """One row per pair with all 24 figures; NaN where one is undefined, infinity for a profit factor without losses."""
    pnl, nan = F.col("pnl_pips"), F.lit(math.nan)
    win, loss = pnl > 0, pnl < 0
    count = lambda c: F.count_if(c)
    part = lambda c: F.coalesce(F.sum(F.when(c, pnl)), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(F.when(c, pnl)), nan)
    held = (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / 1e6
    profit, lost = part(win), part(loss)
    factor = F.when(lost < 0, profit / F.abs(lost)).when(profit > 0, F.lit(math.inf)).otherwise(nan)
    figures = trades.groupBy(by).agg(
        F.count("*").alias("total_trades"), count(win).alias("winning_trades"), count(loss).alias("losing_trades"), count(pnl == 0).alias("breakeven_trades"),
        (count(win) / F.count("*")).alias("win_rate"), F.coalesce(F.sum(pnl), F.lit(0.0)).alias("net_pnl_pips"), profit.alias("gross_profit_pips"), lost.alias("gross_loss_pips"),
        F.coalesce(F.avg(pnl), nan).alias("avg_trade_pips"), mean(win).alias("avg_win_pips"), mean(loss).alias("avg_loss_pips"), factor.alias("profit_factor"),
        F.coalesce(F.avg(pnl), nan).alias("expectancy_pips"), F.percentile("pnl_pips", F.lit(0.5)).alias("median_trade_pips"), F.max(pnl).alias("best_trade_pips"), F.min(pnl).alias("worst_trade_pips"),
        (F.avg(held) / 60.0).alias("avg_holding_minutes"), sharpe(pnl, F.sqrt(F.count(pnl))).alias("per_trade_sharpe"),
    )
    curve = ordered(trades.select(by, "entry_time", "exit_time", "pnl_pips", *[c for c in ("signal_seq",) if c in trades.columns]), by)
    return figures.join(drawdowns(curve, by), by).join(daily_returns(curve, by), by)


def by_outcome(trades: DataFrame) -> DataFrame:
    """Counts and expectancy by pair and outcome, with subtotals (null stands for all)."""
    return trades.rollup("pair", "outcome_label").agg(F.count("*").alias("trades"), F.avg("pnl_pips").alias("avg_pnl_pips"), F.sum("pnl_pips").alias("net_pnl_pips"))
