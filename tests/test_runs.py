"""Shards to ledgers, analyses, sweeps and streams."""

from __future__ import annotations

import csv
import json
import math
from datetime import datetime
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import yaml
from pyspark.sql import functions as F
from test_config import STRATEGY, written

from tickspark.errors import FeedError
from tickspark.files import Files
from tickspark.functions import performance as perf
from tickspark.functions import stratify as strat
from tickspark.operators import engines, kernels
from tickspark.plans import charts, run, sweep_files
from tickspark.sources import ticks as source
from tickspark.sources import trades as ledgers
from tickspark.streaming import live


def shard(base, pair="EURUSD", year=2015, month=1, n=400, seed=1, unit="ns"):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp(year=year, month=month, day=5, tz="UTC")
    at = start + pd.to_timedelta(np.cumsum(rng.uniform(0.5, 20, n)), unit="s")
    mid = 1.2 + np.cumsum(rng.normal(0, 4e-4, n))
    path = base / pair / f"{pair}_{year}-{month:02d}.parquet"
    path.parent.mkdir(parents=True, exist_ok=True)
    table = pa.table({"timestamp": pa.array(at).cast(pa.timestamp(unit, "UTC"), safe=False), "bid": pa.array((mid - 1e-4).astype("float32")), "ask": pa.array((mid + 1e-4).astype("float32"))})
    pq.write_table(table, path)
    return path


def config(tmp_path, **more):
    path = written(tmp_path, **({"end": "2015-01"} | more))
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(STRATEGY | {"strategy": STRATEGY["strategy"] | {"entry": STRATEGY["strategy"]["entry"] | {"predicates": []}}}))
    return path


def test_months():
    assert source.months(2014, 2015, 11, 2) == [(2014, 11), (2014, 12), (2015, 1), (2015, 2)]
    for wrong, error in (((2015, 2014, 1, 1), ValueError), ((2015, 2015, 0, 1), ValueError), ((2015, 2015, 1.0, 2), TypeError)):
        with pytest.raises(error):
            source.months(*wrong)


@pytest.mark.parametrize("unit", ["ns", "us"])
def test_shards(spark, tmp_path, unit):
    a, b = shard(tmp_path, unit=unit), shard(tmp_path, month=2, n=10, unit=unit)
    got = source.read_shards(spark, [str(b), str(a)]).orderBy("instrument", "seq").toPandas()
    wanted = pd.concat([pq.read_table(p).to_pandas() for p in (a, b)])
    assert (got.ts_us.to_numpy() == wanted.timestamp.astype("datetime64[us, UTC]").astype("int64").to_numpy()).all()
    assert (got.mid.to_numpy() == ((wanted.bid.astype(float) + wanted.ask.astype(float)) * 0.5).to_numpy()).all()
    assert set(got.instrument) == {"EURUSD"}


def test_broken_shards(spark, tmp_path):
    with pytest.raises(FeedError):
        source.shard_paths(spark, str(tmp_path), "EURUSD", [(2015, 1)])
    path = tmp_path / "x_2015-01.parquet"
    path.write_text("nothing")
    with pytest.raises(FeedError):
        source.read_shards(spark, [str(path)])
    pq.write_table(pa.table({"bid": [1.0]}), path)
    with pytest.raises(FeedError):
        source.read_shards(spark, [str(path)])


def test_slice(spark, tmp_path):
    t = source.read_shards(spark, [str(shard(tmp_path))])
    a, b = datetime(2015, 1, 5, 0, 5), datetime(2015, 1, 5, 0, 10)
    assert 0 < source.time_slice(t, a, b).count() < t.count()
    assert source.shards_between([(2014, 12), (2015, 1), (2015, 2)], a, b) == [(2015, 1)]


@pytest.mark.parametrize("unit", ["ns", "us"])
def test_bounds_reach_the_scan(spark, tmp_path, unit):
    path = shard(tmp_path, unit=unit)
    a, b = datetime(2015, 1, 5, 0, 5), datetime(2015, 1, 5, 0, 10)
    whole = source.read_shards(spark, [str(path)])
    part = source.read_shards(spark, [str(path)], a, b)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, source.time_slice(whole, a, b).collect()))
    plan = part._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThanOrEqual(timestamp" in pushed


def test_slices_open_only_their_months(spark, tmp_path):
    shard(tmp_path)
    got = source.read_slice(spark, str(tmp_path), "EURUSD", [(2014, 12), (2015, 1), (2015, 2)], datetime(2015, 1, 5, 0, 5), datetime(2015, 1, 5, 0, 10))
    assert got.count() > 0
    with pytest.raises(FeedError):
        source.read_slice(spark, str(tmp_path), "EURUSD", [(2015, 1)], datetime(2016, 1, 1), datetime(2016, 1, 2))


def test_run_analysis_and_stratification(spark, tmp_path):
    shard(tmp_path / "data")
    path = config(tmp_path, pairs=["eurusd", "gbpusd"])
    made = run.run_backtest(spark, path, run_id="one", log_level="WARNING", empty_exit_closes=False)
    folder = tmp_path / "out" / "one"
    assert made["status"] == "completed" and "GBPUSD" in made["pair_failures"] and made["outputs"]["EURUSD"]["trades"]
    saved = json.loads((folder / "manifest.json").read_text())
    assert saved["validation"]["EURUSD"]["accepted_ticks"] == 400
    shards = {s["pair"]: s for s in saved["input_shards"]}
    assert shards["EURUSD"]["rows"] == 400 and len(shards["EURUSD"]["sha256"]) == 64 and shards["GBPUSD"]["errors"] == ["missing_file"]
    assert saved["configs"]["metrics"]["schema_version"] == "1.0" and (folder / "environment.txt").exists()
    assert all(json.loads(x)["run_id"] == "one" for x in (folder / "output/logs/one.log").read_text().splitlines())
    trades = ledgers.load_trades(spark, made["outputs"]["EURUSD"]["trades"])
    assert trades.count() > 5 and "z.z_score" in trades.columns and ledgers.discover(spark, folder / "output").count() == trades.count()
    analysis = run.run_backtest_analysis(spark, folder)
    assert "Max drawdown duration" in analysis.reports["EURUSD"].read_text() and not analysis.failures
    assert run.run_trade_analysis(spark, made["outputs"]["EURUSD"]["trades"], tmp_path / "r.md").figures["total_trades"] == trades.count()
    found = run.run_metric_stratification_analysis(spark, folder, ("scott", "nbins"), 5)["EURUSD"]
    assert set(found.summaries) == {"z.z_score", "z.rolling_residual"} and set(found.reports) == {"scott", "nbins"}
    assert sum(r["count"] for r in found.summaries["z.z_score"]) <= trades.count()
    one = ledgers.pick(trades, seed=3)
    window = ledgers.around(source.read_shards(spark, [str(tmp_path / "data/EURUSD/EURUSD_2015-01.parquet")]), one)
    assert window.count() > 2
    drawn = charts.trade(tmp_path / "trade.svg", window, one.first())
    for path, marks in ((drawn, 2), (folder / "output/EURUSD/analysis/equity.svg", 0), *((p, 0) for p in (folder / "output/EURUSD/analysis/metric_stratification/plots/scott").glob("*.svg"))):
        root = ElementTree.parse(path).getroot()
        assert root.tag.endswith("svg") and len(root.findall("{*}circle")) == marks and root.findall("{*}polyline")
    assert "equity.svg" in (folder / "output/EURUSD/analysis/report.md").read_text()


def test_profile_is_kept(spark, tmp_path):
    import pstats

    shard(tmp_path / "data", n=120)
    made = run.run_backtest(spark, config(tmp_path), run_id="p", log_level="WARNING", profile=True)
    folder = Path(made["output_root"]).parent / "profile"
    assert pstats.Stats(str(folder / "driver.prof")).total_calls > 0 and "MapInArrow" in (folder / "plan.txt").read_text()
    assert json.loads((folder / "stages.json").read_text())["stages"]


def test_thinned_curve(spark):
    rows = spark.range(1, 5001).select(F.lit("P").alias("pair"), F.col("id").alias("n"), F.col("id").cast("double").alias("place"), (F.col("id") * 2.0).alias("v"))
    got = charts.thinned(rows, "place", "v", most=100).collect()
    assert len(got) == 100 and got[-1].v == 10_000.0 and got[0].v == 100.0
    assert charts.thinned(rows.limit(30), "place", "v", most=100).count() == 30


def test_files(spark, tmp_path):
    files = Files(spark)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("1")
    (tmp_path / "b").mkdir()
    files.move(f"file://{tmp_path}/a", str(tmp_path / "b"))
    assert files.listed(str(tmp_path / "b")) == ["x"] and not files.exists(str(tmp_path / "a"))
    files.delete(str(tmp_path / "b"))
    assert not files.exists(f"file://{tmp_path}/b")


def test_broken_shard_in_the_audit(spark, tmp_path):
    good = shard(tmp_path)
    bad = tmp_path / "bad.parquet"
    bad.write_text("nothing")
    facts = run.shard_facts(spark, [str(good), str(bad)])
    assert facts[str(good)]["rows"] > 0 and facts[str(good)]["sha256"] == run.sha256(good)
    assert facts[str(bad)]["rows"] is None and facts[str(bad)]["error"].startswith("metadata_error") and facts[str(bad)]["sha256"] == run.sha256(bad)


def test_two_runs_agree(spark, tmp_path):
    shard(tmp_path / "data", n=150)
    assert run.deterministic(spark, config(tmp_path), tmp_path / "twice")


def test_no_trades_no_file(spark, tmp_path):
    shard(tmp_path / "data", n=5)
    made = run.run_backtest(spark, config(tmp_path, warmup_seconds=10_000), run_id="none", log_level="WARNING")
    assert made["outputs"] == {"EURUSD": {"trades": None}} and made["status"] == "completed"


def test_sweep_files(spark, tmp_path, monkeypatch):
    from tickspark.plans import sweep

    shard(tmp_path / "data", n=120)
    path = config(tmp_path)
    small = lambda s: sweep_grid(s, (0, 30), ((10, 10),), (60,))
    sweep_grid = sweep.grid
    assert sweep.grid(spark).count() == 80
    monkeypatch.setattr(sweep, "grid", small)
    manifest = sweep_files.build(spark, tmp_path / "s.yaml", tmp_path / "grid")
    assert [r["label"] for r in csv.DictReader(manifest.open())] == ["min0_tp10_sl10_timeout60", "min30_tp10_sl10_timeout60"]
    first = sweep_files.run_all(spark, manifest, path, tmp_path / "runs")
    assert set(first.values()) == {"ok"} and set(sweep_files.run_all(spark, manifest, path, tmp_path / "runs").values()) == {"skipped"}
    rows = sweep_files.summarise(spark, manifest, tmp_path / "runs").collect()
    assert [r.min_recency_seconds for r in rows] == sorted(r.min_recency_seconds for r in rows) and rows


def trades_of(spark, pnl, days=None):
    rows = [("P", i, f"2020-01-{(days[i] if days else 1):02d} 10:{i:02d}:00", f"2020-01-{(days[i] if days else 1):02d} 10:{i + 2:02d}:00", float(p)) for i, p in enumerate(pnl)]
    df = spark.createDataFrame(rows, "pair string, signal_seq long, a string, b string, pnl_pips double")
    return df.select("pair", "signal_seq", F.col("a").cast("timestamp").alias("entry_time"), F.col("b").cast("timestamp").alias("exit_time"), "pnl_pips")


def test_performance(spark):
    f = perf.performance(trades_of(spark, [10, -5, 0])).first()
    assert (f.total_trades, f.winning_trades, f.losing_trades, f.breakeven_trades, f.net_pnl_pips) == (3, 1, 1, 1, 5)
    assert (f.win_rate, f.avg_holding_minutes, f.profit_factor) == pytest.approx((1 / 3, 2.0, 2.0))
    assert (f.max_drawdown_pips, f.max_drawdown_seconds) == (-5.0, 60.0)
    assert f.sampled_days == 0 and math.isnan(f.daily_sharpe)


def test_performance_limits(spark):
    f = perf.performance(trades_of(spark, [-5, 1])).first()
    assert f.max_drawdown_pips == 0.0  # a first loss is no drawdown
    assert math.isinf(perf.performance(trades_of(spark, [5, 5])).first().profit_factor)
    f = perf.performance(trades_of(spark, [0, 0])).first()
    assert math.isnan(f.profit_factor) and math.isnan(f.per_trade_sharpe) and math.isnan(f.avg_win_pips)


def test_daily_returns(spark):
    pnl, days = [3, -1, 4, -2, 6], [1, 1, 3, 7, 8]
    f = perf.performance(trades_of(spark, pnl, days)).first()
    equity = pd.Series(np.cumsum(pnl), index=pd.to_datetime([f"2020-01-{d:02d}" for d in days])).resample("1D").last().ffill().diff().dropna()
    assert (f.sampled_days, f.daily_return_mean, f.daily_return_std) == pytest.approx((len(equity), equity.mean(), equity.std()))
    assert f.daily_sharpe == pytest.approx(equity.mean() / equity.std() * math.sqrt(252))


def test_bins_match_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": np.round(rng.normal(0, 2, 3000), 2), "pnl_pips": rng.normal(0, 1, 3000)})
    pdf.loc[:5, "x"] = np.nan
    out = strat.stratify(spark.createDataFrame(pdf), ["x"], [strat.Binning("nbins", nbins=30)]).orderBy("bin").toPandas()
    ok = pdf.dropna()
    lo, hi = np.quantile(ok.x, [0.001, 0.999])
    v = ok.x[(ok.x >= lo) & (ok.x <= hi)]
    edges = np.linspace(v.min(), v.max(), 31)
    cut = pd.cut(ok.x, edges, include_lowest=True)
    wanted = ok.groupby(cut, observed=True).pnl_pips.agg(["size", "mean", "std", "median"])
    assert out["count"].tolist() == wanted["size"].tolist()
    np.testing.assert_allclose(out[["avg_pnl", "std_pnl", "median_pnl"]], wanted[["mean", "std", "median"]])
    np.testing.assert_allclose([(r.left, r.right) for r in wanted.index], out[["bin_left_label", "bin_right_label"]])


def test_labels():
    edges = list(np.linspace(1.23456, 3.98765, 5))
    np.testing.assert_allclose(strat.shown_edges(edges)[:2], [(1.234, 1.923), (1.923, 2.611)])
    assert strat.merged([0, 1, 2, 3, 4], [1, 2, 3, 1], 3) == [0, 2, 3, 4]


def test_nothing_to_stratify(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "pnl_pips double, flat double")
    assert strat.stratify(df, ["flat", "absent"]).count() == 0
    with pytest.raises(ValueError):
        strat.Binning("other")


def test_reading_ledgers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ledgers.load_trades(spark, str(tmp_path / "none"))
    spark.createDataFrame([(1.0,)], "pnl_pips double").write.parquet(str(tmp_path / "a"))
    with pytest.raises(ValueError, match="missing"):
        ledgers.load_trades(spark, str(tmp_path / "a"))
    trades_of(spark, [1]).limit(0).write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="no rows"):
        ledgers.load_trades(spark, str(tmp_path / "b"))


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    us = np.cumsum((rng.uniform(0, 5, 300) * 1e6).astype(int))
    us[150] -= 60_000_000  # late
    mid = np.round(1.2 + np.cumsum(rng.normal(0, 4e-4, 300)), 4)
    quotes = pd.DataFrame({"instrument": "A", "seq": np.arange(300), "ts_us": us, "bid": mid - 1e-4, "ask": mid + 1e-4})
    for k, part in enumerate(np.array_split(quotes, 3)):
        part.to_parquet(tmp_path / f"{k}.parquet", index=False)
    p = engines.make_params("threshold_reversion", {"lookback_seconds": 60, "threshold_pips": 10})
    stream = live.reversion_stream(live.tick_stream(spark, str(tmp_path), "instrument string, seq long, ts_us long, bid double, ask double"), p, 1e-4)
    q = stream.writeStream.format("memory").queryName("positions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("positions").orderBy("seq").toPandas()
    assert len(got) == 300 and got.regression.tolist() == (np.arange(300) == 150).tolist()
    kept = np.delete(np.arange(300), 150)
    m = (quotes.bid + quotes.ask).to_numpy()[kept] * 0.5
    wanted = kernels.Reversion(60, 10, 10, 10, 1e-4).run(us[kept], m)["position"]
    assert got.position.dropna().tolist() == wanted.tolist()


def test_windowed_counts(spark):
    df = spark.createDataFrame([("A", 0, 0, 1.0, 1.5), ("A", 1, 299_000_000, 1.0, 1.5), ("A", 2, 300_000_000, 1.0, 2.0)], "instrument string, seq long, ts_us long, bid double, ask double")
    assert [(r.ticks, r.avg_spread) for r in live.windowed_counts(df).orderBy("start").collect()] == [(2, 0.5), (1, 1.0)]


