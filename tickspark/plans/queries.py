"""One registered query per operator over the event ticks, and DuckDB SQL for those that SQL can express.

Events are some minutes apart, so windows are hours and a pip is 1.0.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.files import Files
from tickspark.functions import performance as perf
from tickspark.functions import stratify as strat
from tickspark.operators import engines, simulate, validate
from tickspark.operators.metrics import add_metrics, make_metric
from tickspark.operators.predicates import Predicate, all_hold, holds
from tickspark.plans import sweep
from tickspark.plans.run import fingerprint
from tickspark.session import prepare
from tickspark.sources import trades as ledgers
from tickspark.sources.ticks import from_events, read_shards, read_slice, shard_path, shard_paths, with_mid

H = 3600


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(prepare(spark).read.parquet(f"{sf_dir}/events.parquet"))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.accepted(validate.audit(ticks(spark, sf_dir)))


def r(name: str, digits: int = 6) -> Column:
    """A metric column, rounded, without negative zero, NaN as null, under a name without a dot."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), F.round(c, digits) + 0.0).alias(name.replace(".", "_"))


def q_ticks(spark, sf_dir):
    return ticks(spark, sf_dir).select("instrument", "seq", "ts_us", "bid", F.round("ask", 6).alias("ask"), F.round("mid", 6).alias("mid"))


def q_flagship(spark, sf_dir):
    """Spread, tick rate and session per tick; ticks of busy times; averages per instrument and session."""
    m = add_metrics(accepted(spark, sf_dir), [make_metric("spread", "spread", {"pip_size": 0.01, "window_seconds": 3 * H}), make_metric("rate", "tick_rate", {"window_seconds": 3 * H}), make_metric("session", "session")])
    busy = m.filter(holds(Predicate("rate.tick_count", ">=", 3), m.schema))
    return busy.groupBy("instrument", F.col("`session.session_label`").alias("session_label")).agg(
        F.count("*").alias("n"),
        F.round(F.avg("`spread.spread_pips`"), 6).alias("avg_spread_pips"),
        F.round(F.avg("`spread.spread_percentile`"), 6).alias("avg_percentile"),
        F.round(F.avg("`rate.tick_count`"), 6).alias("avg_count"),
    )


def faulty(spark, sf_dir):
    """The ticks with faults put in: missing bids, crossed quotes, late and repeated times."""
    from pyspark.sql import Window

    t, k = ticks(spark, sf_dir), F.col("seq")
    before = F.lag("ts_us").over(Window.partitionBy("instrument").orderBy("seq"))
    us = F.when(k % 83 == 0, F.col("ts_us") - 86_400_000_000).when(k % 71 == 0, F.coalesce(before, F.col("ts_us"))).otherwise(F.col("ts_us"))
    bid = F.when(k % 97 == 0, None).otherwise(F.col("bid"))
    ask = F.when(k % 89 == 0, F.col("bid") - 0.5).otherwise(F.col("ask"))
    return with_mid(t.select("instrument", "seq", us.alias("ts_us"), bid.alias("bid"), ask.alias("ask")))


def q_validate(spark, sf_dir):
    return validate.audit(faulty(spark, sf_dir)).select("instrument", "seq", "ts_us", "issue")


def q_tally(spark, sf_dir):
    t = validate.tally(validate.audit(faulty(spark, sf_dir)))
    issue = lambda k: F.coalesce(F.col("issues")[k], F.lit(0)).alias(k.replace(":", "_"))
    return t.select("instrument", "total_ticks", "accepted_ticks", "skipped_ticks", issue("missing_field:bid"), issue("negative_spread"), issue("timestamp_regression"))


def metric_query(*specs: tuple[str, str, dict], digits: int = 6) -> Callable:
    """A query that returns the metrics' columns for every tick of the faulty stream that passes validation."""

    def run(spark, sf_dir):
        good = validate.accepted(validate.audit(faulty(spark, sf_dir)))
        made = [make_metric(n, k, p) for n, k, p in specs]
        m = add_metrics(good, made)
        return m.select("instrument", "seq", *[F.col(f"`{c}`").alias(c.replace(".", "_")) if c.endswith("label") else r(c, digits) for x in made for c in x.columns()])

    return run


EWMAS = (("fast", "ewma", {"tau_seconds": 2 * H}), ("slow", "ewma", {"tau_seconds": 8 * H}))


def averaged(spark, sf_dir):
    return add_metrics(accepted(spark, sf_dir), [make_metric(*x) for x in (*EWMAS, ("rate", "tick_rate", {"window_seconds": 3 * H}))])


CROSSOVER = simulate.Strategy(
    name="crossover", entry_name="crossover_entry", engine="ewma_crossover",
    params=engines.make_params("ewma_crossover", {"fast_metric": "fast.ewma", "slow_metric": "slow.ewma", "short_on_cross": True, "tp_pips": 30, "sl_pips": 20, "trade_timeout_seconds": 6 * H}),
    entry_predicates=(Predicate("rate.tick_count", ">", 2),), exit_name="far_exit", exit_predicates=(Predicate("fast.ewma", ">", 75.0),),
)
REVERSION = simulate.Strategy(
    name="reversion", entry_name="reversion_entry", engine="threshold_reversion",
    params=engines.make_params("threshold_reversion", {"lookback_seconds": 6 * H, "threshold_pips": 40, "tp_pips": 30, "sl_pips": 60, "min_recency_seconds": 600, "trade_timeout_seconds": 12 * H}),
    entry_predicates=(Predicate("rate.tick_count", ">", 2),), exit_name="none", empty_exit_closes=False,
)


def q_predicates(spark, sf_dir):
    """Every operator, a metric against a metric, absolute values, and a metric that does not exist."""
    m = averaged(spark, sf_dir).withColumn("gap.x", F.when(F.col("seq") % 11 == 0, F.lit(float("nan"))).when(F.col("seq") % 13 == 0, None).otherwise(F.col("mid") - 50))
    tests = {
        "lt": Predicate("gap.x", "<", 0.0), "le": Predicate("gap.x", "<=", 0.0), "gt_abs": Predicate("gap.x", ">", 10.0, use_abs=True), "ge": Predicate("gap.x", ">=", 5.0),
        "eq": Predicate("rate.tick_count", "==", 4), "ne": Predicate("gap.x", "!=", 0.0), "other": Predicate("fast.ewma", ">", other_metric="slow.ewma"), "absent": Predicate("nothing.x", "!=", 1.0),
    }
    return m.select("instrument", "seq", *[holds(p, m.schema).alias(k) for k, p in tests.items()], all_hold(list(tests.values())[:4], m.schema).alias("all_four"), all_hold([], m.schema).alias("of_none"))


def q_signals(spark, sf_dir):
    s = simulate.signals(averaged(spark, sf_dir), CROSSOVER, 1.0, 86_400.0)
    return s.select("instrument", "seq", "live", F.col("sig_direction").alias("direction"), "should_open", "should_close", "reason")


def ledger(t: DataFrame) -> DataFrame:
    return t.select(
        "pair", "signal_seq", F.unix_micros("entry_time").alias("entry_us"), F.unix_micros("exit_time").alias("exit_us"), "direction", F.round("entry_price", 6).alias("entry_price"),
        F.round("exit_price", 6).alias("exit_price"), F.round("pnl_pips", 6).alias("pnl_pips"), F.round("holding_seconds", 6).alias("holding_seconds"), "outcome_label",
    )


def q_crossover_trades(spark, sf_dir):
    return ledger(simulate.run_strategy(averaged(spark, sf_dir), CROSSOVER, 1.0, 86_400.0))


def q_stub_trades(spark, sf_dir):
    return ledger(simulate.run_strategy(averaged(spark, sf_dir), simulate.NO_STRATEGY, 1.0, 0.0))


def q_reversion_metric(spark, sf_dir):
    params = {"lookback_seconds": 6 * H, "threshold_pips": 40, "pip_size": 1.0, "tp_pips": 30, "sl_pips": 60, "min_recency_seconds": 600}
    m = add_metrics(accepted(spark, sf_dir), [make_metric("rev", "threshold_reversion", params)])
    return m.select("instrument", "seq", *[r(f"rev.{x}") for x in ("position", "reference_price", "distance_from_reference", "reference_age_seconds", "tp_price", "sl_price", "position_open_age_seconds")])


def q_reversion_trades(spark, sf_dir):
    return ledger(simulate.run_strategy(averaged(spark, sf_dir), REVERSION, 1.0, 86_400.0))


def sample_trades(spark, sf_dir):
    """A ledger made of the events, for the analyses: one trade per event."""
    t = ticks(spark, sf_dir)
    hold = (F.col("seq") * 7919 % 7200 + 60) * 1_000_000
    entry, exit_ = F.timestamp_micros("ts_us"), F.timestamp_micros(F.col("ts_us") + hold)
    return t.select(
        F.col("instrument").alias("pair"),
        F.col("seq").alias("signal_seq"),
        entry.alias("entry_time"),
        exit_.alias("exit_time"),
        (F.round("bid", 2) - 50).alias("pnl_pips"),
        F.when(F.col("bid") > 50, "TP").otherwise("SL").alias("outcome_label"),
        (hold / 1e6).alias("holding_seconds"),
        F.col("bid").alias("m.value"),
        (F.col("seq") % 17 + F.col("bid") / 100).alias("m.other"),
    )


def q_performance(spark, sf_dir):
    p = perf.performance(sample_trades(spark, sf_dir))
    whole = {"pair", "total_trades", "winning_trades", "losing_trades", "breakeven_trades", "sampled_days"}
    return p.select(*[F.col(c) if c in whole else r(c) for c in p.columns])


def q_equity(spark, sf_dir):
    c = perf.equity_curve(sample_trades(spark, sf_dir))
    return c.select("pair", F.col("n").cast("long").alias("n"), F.unix_micros("exit_time").alias("exit_us"), r("pnl_pips"), r("cumulative_pnl"), r("drawdown"))


def q_outcomes(spark, sf_dir):
    return perf.by_outcome(sample_trades(spark, sf_dir)).select("pair", "outcome_label", "trades", r("avg_pnl_pips"), r("net_pnl_pips"))


def q_stratify(spark, sf_dir, merge=False):
    modes = [strat.Binning("nbins", nbins=25), strat.Binning("fd"), strat.Binning("scott"), strat.Binning("sigma"), strat.Binning("fixed", width=7.3)]
    if merge:
        modes = [strat.Binning("nbins", nbins=25, merge_to_min_count=True, min_count=60)]
    s = strat.stratify(sample_trades(spark, sf_dir), ["m.value", "m.other", "m.absent"], modes)
    fields = ["bin_left", "bin_right", "std_pnl", "median_pnl", "win_rate", "se"]
    # means of a few two-digit values end on a 5: eight digits keep them off a rounding tie
    return s.select("metric", "mode", F.col("bin").cast("long").alias("bin"), "count", r("avg_pnl", 8), *[r(c, 4) for c in fields])


def q_plot_rows(spark, sf_dir):
    s = strat.stratify(sample_trades(spark, sf_dir), ["m.value"], [strat.Binning("nbins", nbins=30, min_count=5)])
    return strat.plot_rows(s).select("metric", F.col("bin").cast("int").alias("bin"), "count", r("bin_center"), r("avg_pnl", 8), r("smoothed", 8), r("x_low"), r("x_high"))


def q_overall(spark, sf_dir):
    o = strat.overall(sample_trades(spark, sf_dir).withColumn("m.value", F.when(F.col("signal_seq") % 9 != 0, F.col("`m.value`"))), ["m.value"])
    return o.select("trades", r("expectancy"), r("win_rate"), F.col("`m.value.nulls`").alias("value_nulls"))


def q_focus(spark, sf_dir):
    """Trades held at most 250 seconds, in bins of holding time."""
    focus = sample_trades(spark, sf_dir).filter("holding_seconds BETWEEN 0 AND 250")
    s = strat.stratify(focus, ["holding_seconds"], [strat.Binning("fixed", width=2.5, min_count=20, clip=(0.0, 1.0))])
    return s.select("metric", F.col("bin").cast("long").alias("bin"), "count", r("avg_pnl", 8), r("bin_left", 4))


def q_sweep_bins(spark, sf_dir):
    s = strat.sweep_bins(sample_trades(spark, sf_dir), "m.value")
    return s.select(F.col("bin").cast("long").alias("bin"), "count", r("win_rate"), r("avg_pnl", 8), r("std_pnl"))


def q_sweep_grid(spark, sf_dir):
    return sweep.grid(prepare(spark))


def q_sweep_summary(spark, sf_dir):
    """A grid of the usual 5 x 4 x 4 configurations, in hours as the events are."""
    grid = sweep.grid(prepare(spark), min_recency_seconds=(0, 600, 1800, 3600, 7200), tp_sl=((30, 30), (40, 20), (20, 40), (60, 60)), trade_timeout_seconds=(2 * H, 6 * H, 12 * H, 24 * H))
    done = sweep.run(accepted(spark, sf_dir), grid, lookback_seconds=6 * H, threshold_pips=40, pip_size=1.0, warmup_s=86_400.0)
    return sweep.summary(done).select("label", "pair", "trade_count", r("avg_pnl_pips"), "min_recency_seconds", "tp_pips", "trade_timeout_seconds")


def q_slice(spark, sf_dir):
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    return from_events(events, "2024-01-05 00:00:00", "2024-01-07 12:00:00").select("instrument", "seq", "ts_us", F.round("mid", 6).alias("mid"))


def written_shards(spark, sf_dir) -> str:
    """The events as monthly shards per instrument, quotes as 32-bit floats, in the folder that executors share (a local one where none is set)."""
    base = scratch(spark, "shards")
    quotes = ticks(spark, sf_dir).select("instrument", "seq", F.col("ts").alias("timestamp"), F.col("bid").cast("float").alias("bid"), F.col("ask").cast("float").alias("ask"))
    for name in PAIRS:
        one = quotes.filter(F.col("instrument") == name).orderBy("seq").select("timestamp", "bid", "ask")
        one.coalesce(1).write.parquet(shard_path(base, name, *MONTH))
    return base


#: Instruments and month of the event table.
PAIRS, MONTH = ("click", "error", "purchase", "signup", "view"), (2024, 1)


def scratch(spark, what: str) -> str:
    """A new path in the folder that executors share; a local master may have none and gets a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tickspark-')}"
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written_ledgers(spark, sf_dir) -> str:
    """The output folder of a run whose pairs' ledgers are sample_trades()."""
    out = scratch(spark, "run") + "/output"
    sample_trades(spark, sf_dir).withColumn("__pair", F.col("pair")).write.partitionBy("__pair").parquet(f"{out}/_stage")
    files = Files(spark)
    for name in PAIRS:
        files.move(f"{out}/_stage/__pair={name}", f"{out}/{name}/trades.parquet")
    files.delete(f"{out}/_stage")
    return out


def q_discovered(spark, sf_dir):
    """All ledgers below a run's folder, found by name, as one table."""
    rows = ledgers.discover(prepare(spark), written_ledgers(spark, sf_dir))
    return rows.select("pair", "signal_seq", F.unix_micros("entry_time").alias("entry_us"), F.unix_micros("exit_time").alias("exit_us"), r("pnl_pips"), "outcome_label")


def q_loaded(spark, sf_dir):
    """One pair's ledger, checked and in order of exit, with the columns of the metric m."""
    t = ledgers.load_trades(prepare(spark), f"{written_ledgers(spark, sf_dir)}/{PAIRS[1]}/trades.parquet")
    return t.select("pair", "signal_seq", F.unix_micros("exit_time").alias("exit_us"), *[r(c) for c in strat.metric_columns(t, ["m"])])


def q_picked(spark, sf_dir):
    """The hundredth trade by exit, with the ticks around it."""
    one = ledgers.pick(sample_trades(spark, sf_dir).filter(F.col("pair") == PAIRS[2]), index=99)
    return ledgers.around(ticks(spark, sf_dir), one, least_padding_s=6 * H).select("instrument", "seq", "ts_us", F.round("mid", 6).alias("mid"))


def q_runs_agree(spark, sf_dir):
    """Order-free digests of two runs of one ledger, the second from reshuffled ticks: equal ones are one row."""
    prints = []
    for width in (3, 7):
        t = simulate.run_strategy(averaged(spark, sf_dir).repartition(width), CROSSOVER, 1.0, 86_400.0)
        prints.append(fingerprint(t))
    return spark.createDataFrame([(p.split(":")[0], len(set(prints))) for p in set(prints)], "trades string, different long").select(F.col("trades").cast("long").alias("trades"), "different")


def shard_columns(t: DataFrame) -> DataFrame:
    return t.select("instrument", "seq", "ts_us", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"), F.round("mid", 6).alias("mid"))


def q_shards(spark, sf_dir):
    base = written_shards(spark, sf_dir)
    return shard_columns(read_shards(prepare(spark), [p for name in PAIRS for p in shard_paths(spark, base, name, [MONTH])]))


def q_shard_slice(spark, sf_dir):
    """One instrument's ticks of two days, from the shard of the month that the days touch."""
    base = written_shards(spark, sf_dir)
    return shard_columns(read_slice(spark, base, PAIRS[0], [(2023, 12), MONTH, (2024, 2)], datetime(2024, 1, 5), datetime(2024, 1, 7, 12)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "flagship_session_spread": q_flagship,
        "ticks": q_ticks,
        "time_slice": q_slice,
        "shard_ticks": q_shards,
        "shard_slice": q_shard_slice,
        "ledger_discovery": q_discovered,
        "ledger_loading": q_loaded,
        "trade_window": q_picked,
        "runs_agree": q_runs_agree,
        "validate": q_validate,
        "validation_tally": q_tally,
        "metric_ewma": metric_query(("e", "ewma", {"tau_seconds": 2 * H}), ("b", "ewma", {"tau_seconds": 5 * H, "price_field": "BID"})),
        "metric_ewma_slope": metric_query(("s", "ewma_slope", {"tau_seconds": 2 * H, "window_seconds": 3 * H})),
        "metric_ewma_vol": metric_query(("v", "ewma_vol", {"tau_seconds": 2 * H, "percentile_horizon_seconds": 12 * H, "bins": 64, "base_vol": 0.5})),
        "metric_zscore_drift": metric_query(("z", "zscore", {"lookback_seconds": 6 * H}), ("d", "drift_sign", {"lookback_seconds": 6 * H}), digits=4),
        "metric_spread": metric_query(("sp", "spread", {"pip_size": 0.01, "window_seconds": 3 * H})),
        "metric_tick_rate": metric_query(("tr", "tick_rate", {"window_seconds": 3 * H})),
        "metric_session": metric_query(("s", "session", {})),
        "metric_threshold_reversion": q_reversion_metric,
        "predicates": q_predicates,
        "signals_crossover": q_signals,
        "trades_crossover": q_crossover_trades,
        "trades_reversion": q_reversion_trades,
        "trades_stub": q_stub_trades,
        "performance": q_performance,
        "equity_curve": q_equity,
        "outcomes": q_outcomes,
        "stratify": q_stratify,
        "stratify_merged": lambda s, d: q_stratify(s, d, merge=True),
        "stratify_plot_rows": q_plot_rows,
        "stratify_overall": q_overall,
        "stratify_focus": q_focus,
        "sweep_bins": q_sweep_bins,
        "sweep_grid": q_sweep_grid,
        "sweep_summary": q_sweep_summary,
    }
