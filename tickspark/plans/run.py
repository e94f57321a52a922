"""A whole run: configuration to ledgers with an audited manifest, then analysis and stratification."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import logging
import shutil
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark import logs
from tickspark.config import BacktestConfig, backtest_config, metrics_config
from tickspark.errors import ConfigError, FeedError
from tickspark.files import Files, arrow_filesystem
from tickspark.functions import performance as perf
from tickspark.functions import stratify as strat
from tickspark.operators import simulate, validate
from tickspark.operators.metrics import add_metrics
from tickspark.plans import charts, report
from tickspark.session import prepare
from tickspark.sources import trades as ledgers
from tickspark.sources.ticks import months, read_shards, shard_path, shard_paths

log = logging.getLogger("tickspark.run")
#: Metrics that a stratification looks for when none are named.
DEFAULT_METRICS = ("z30m", "z5m", "ewma_vol_5m", "ewma_vol_30m", "drift_sign", "ewma_mid_5m_slope", "spread_60s", "tick_rate_30s")


def sha256(path: Path) -> str | None:
    try:
        with path.open("rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        return None


def snapshot(path: Path, folder: Path) -> dict:
    """Copy a configuration into the run; its copy, hash and schema version."""
    folder.mkdir(parents=True, exist_ok=True)
    copy = folder / path.name
    shutil.copy2(path, copy)
    content = yaml.safe_load(copy.read_text())
    return {"source": str(path.resolve()), "path": str(copy), "sha256": sha256(copy), "schema_version": content.get("schema_version") if isinstance(content, dict) else None}


def shard_facts(spark: SparkSession, paths: list[str]) -> dict[str, dict]:
    """Rows, SHA-256 and error by path: executors read each file in pieces of some megabytes."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column(0).to_pylist():
                digest, rows, error = hashlib.sha256(), None, None
                try:
                    fs, at = arrow_filesystem(path)
                    with fs.open_input_file(at) as file:
                        while piece := file.read(8 << 20):
                            digest.update(piece)
                        rows = pq.ParquetFile(file).metadata.num_rows
                except Exception as wrong:
                    error = f"metadata_error: {wrong}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()]), pa.array([rows], pa.int64()), pa.array([error], pa.string())], names=["path", "sha256", "rows", "error"])

    if not paths:
        return {}
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")
    return {r.path: r.asDict() for r in listed.mapInArrow(run, "path string, sha256 string, rows long, error string").collect()}


def shard_audit(spark: SparkSession, config: BacktestConfig) -> list[dict]:
    """Rows, SHA-256 and errors of every input shard."""
    wanted = months(config.start[0], config.end[0], config.start[1], config.end[1])
    shards = [{"pair": p, "year_month": f"{y}-{m:02d}", "path": shard_path(str(config.data_base_path), p, y, m)} for p in config.pairs for y, m in wanted]
    files = Files(spark)
    facts = shard_facts(spark, [s["path"] for s in shards if files.exists(s["path"])])
    for s in shards:
        found = facts.get(s["path"])
        s["rows"], s["sha256"] = (found["rows"], found["sha256"]) if found else (None, None)
        if not found or found["error"]:
            s["errors"] = [found["error"] if found else "missing_file"]
    return shards


def environment(path: Path) -> None:
    """Installed packages and versions."""
    names = sorted(f"{d.metadata['Name']}=={d.version}" for d in importlib.metadata.distributions())
    path.write_text(f"python=={sys.version.split()[0]}\n" + "\n".join(names) + "\n")


def simulate_all(spark: SparkSession, config: BacktestConfig, block_s: float | None = None) -> tuple[DataFrame | None, DataFrame | None, dict[str, str]]:
    """(trades, audited ticks, failures by pair): one lazy plan over all pairs whose shards exist and can be read."""
    wanted = months(config.start[0], config.end[0], config.start[1], config.end[1])
    paths, failures = [], {}
    for p in config.pairs:
        try:
            own = shard_paths(spark, str(config.data_base_path), p, wanted)
            read_shards(spark, own)
            paths += own
        except FeedError as wrong:
            failures[p] = str(wrong)
            log.error("pair skipped", extra={"failed": p, "error": str(wrong)})
    if not paths:
        return None, None, failures
    audited = validate.audit(read_shards(spark, paths))
    metrics = add_metrics(validate.accepted(audited), config.metrics, block_s)
    return simulate.run_strategy(metrics, config.strategy, config.pip_size, config.warmup_seconds), audited, failures


def run_backtest(
    spark: SparkSession,
    config_path: str | Path,
    *,
    output_root: str | Path | None = None,
    run_id: str | None = None,
    log_level: str = "INFO",
    block_s: float | None = None,
    empty_exit_closes: bool = True,
    explain: bool = False,
    profile: bool = False,
) -> dict:
    """Run a configuration and write {root}/{run}/output/{pair}/trades.parquet, logs, configuration copies and manifest.json.

    A pair without trades gets no file. A pair whose data are missing or broken is recorded in pair_failures; the
    others run. If one pair breaks the common plan, pairs run one by one, so that only it fails. With profile, the run's
    folder gets profile/driver.prof (calls of the driver's Python, for pstats), plan.txt and stages.json.
    """
    prepare(spark)
    run_id = run_id or logs.new_run_id()
    try:
        config = backtest_config(config_path, empty_exit_closes)
    except ConfigError:
        logs.setup(run_id, None, log_level).exception("configuration rejected", extra={"config": str(config_path)})
        raise
    root = Path(output_root).expanduser() if output_root else config.output_base_path
    folder, out = root / run_id, root / run_id / "output"
    logger = logs.setup(run_id, out / "logs", log_level)
    manifest = {
        "run_id": run_id, "timestamp_utc": datetime.now(UTC).isoformat(), "code_ref": logs.git_hash(Path(__file__).parent), "cli": {"config": str(Path(config_path).resolve())}, "output_root": str(out.resolve()),
        "log_path": str((out / "logs" / f"{run_id}.log").resolve()), "status": "pending",
        "configs": {k: snapshot(p, folder / "configs") for k, p in (("backtest", Path(config_path)), ("metrics", config.metrics_config_path), ("strategy", config.strategy_config_path))},
        "input_shards": shard_audit(spark, config), "pairs": list(config.pairs),
    }
    write = lambda: (folder / "manifest.json").write_text(json.dumps(manifest, indent=2, default=str))
    write()
    profiler = Profiler(spark, folder / "profile") if profile else None
    try:
        trades, audited, failures = simulate_all(spark, config, block_s)
        if trades is not None:
            if explain:
                trades.explain("formatted")
            if profiler:
                profiler.plan(trades)
            written, broken = _write(spark, config, trades, audited, out, failures, block_s)
            manifest |= written
            failures |= broken
        manifest |= {"pair_failures": failures, "status": "completed"}
    except Exception as wrong:
        manifest |= {"status": "failed", "error": str(wrong)}
        logger.exception("run failed")
        raise
    finally:
        if profiler:
            profiler.close()
        try:
            environment(folder / "environment.txt")
        except Exception:
            logger.exception("environment could not be recorded")
        write()
    return manifest


class Profiler:
    """Calls of the driver's Python, the plan, and the seconds of every job and stage that ran meanwhile."""

    def __init__(self, spark: SparkSession, folder: Path) -> None:
        import cProfile

        self.spark, self.folder, self.calls, self.begin = spark, folder, cProfile.Profile(), datetime.now(UTC)
        folder.mkdir(parents=True, exist_ok=True)
        self.calls.enable()

    def plan(self, df: DataFrame) -> None:
        (self.folder / "plan.txt").write_text(df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))

    def close(self) -> None:
        self.calls.disable()
        self.calls.dump_stats(self.folder / "driver.prof")
        store, begin, stages = self.spark.sparkContext._jsc.sc().statusStore(), self.begin.timestamp() * 1000, []
        listed = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
        for k in range(listed.size()):
            s = listed.apply(k)
            if s.submissionTime().isDefined() and s.submissionTime().get().getTime() >= begin:
                told = {"stage": s.stageId(), "name": s.name(), "tasks": s.numTasks(), "seconds": s.executorRunTime() / 1000}
                stages.append(told | {"shuffle_read": s.shuffleReadBytes(), "shuffle_write": s.shuffleWriteBytes(), "spilled": s.diskBytesSpilled()})
        (self.folder / "stages.json").write_text(json.dumps({"seconds": (datetime.now(UTC) - self.begin).total_seconds(), "stages": stages}, indent=2))


def _write(spark, config, trades, audited, out: Path, failures: dict, block_s) -> tuple[dict, dict]:
    """Write each pair's ledger; (outputs and validation for the manifest, further failures)."""
    pairs, broken = [p for p in config.pairs if p not in failures], {}
    try:
        stats = {r.instrument: r.asDict() for r in validate.tally(audited).collect()}
        _split(trades, out)
    except Exception as wrong:
        log.warning("the common plan failed; pairs run one by one", extra={"error": str(wrong)[:500]})
        stats = {}
        for p in pairs:
            try:
                from dataclasses import replace

                one, ticks, _ = simulate_all(spark, replace(config, pairs=(p,)), block_s)
                stats |= {r.instrument: r.asDict() for r in validate.tally(ticks).collect()}
                _split(one, out)
            except Exception as own:
                broken[p] = str(own)
    found = ledgers.discover_paths(spark, out)
    return {"outputs": {p: {"trades": str(found[p]), "sha256": None} if p in found else {"trades": None} for p in pairs}, "validation": stats}, broken


def _split(trades: DataFrame, out: Path) -> None:
    """One {pair}/trades.parquet each, from one partitioned write; moved through the file system that Spark writes to."""
    files, stage = Files(trades.sparkSession), f"{out}/_stage"
    trades.withColumn("__pair", F.col("pair")).write.mode("overwrite").partitionBy("__pair").parquet(stage)
    for name in files.listed(stage):
        if name.startswith("__pair="):
            files.move(f"{stage}/{name}", f"{out}/{name.partition('=')[2]}/trades.parquet")
    files.delete(stage)


@dataclass
class TradeAnalysis:
    figures: dict
    report: Path | None


def run_trade_analysis(spark: SparkSession, trades_path: str | Path, report_path: str | Path | None = None) -> TradeAnalysis:
    """Figures of one ledger and their report."""
    df = ledgers.load_trades(spark, str(trades_path))
    if "pair" not in df.columns:
        df = df.withColumn("pair", F.lit(Path(trades_path).parent.name))
    figures = perf.performance(df.withColumn("pair", F.lit("all"))).first().asDict()
    path = Path(report_path) if report_path else Path(trades_path).with_name(Path(trades_path).stem + "_report.md")
    charts_of = _equity_charts(df.withColumn("pair", F.lit("all")), {"all": path.with_name(path.stem + "_equity.svg")})
    return TradeAnalysis(figures, report.performance_report(path, str(trades_path), figures, charts_of.get("all")))


def _equity_charts(trades: DataFrame, paths: dict[str, Path]) -> dict[str, Path]:
    """An equity chart per pair, of at most a thousand points each."""
    points: dict[str, list] = {}
    curve = perf.equity_curve(trades).withColumn("place", F.col("n").cast("double"))
    for r in charts.thinned(curve, "place", "cumulative_pnl").collect():
        points.setdefault(r.pair, []).append((r.place, r.cumulative_pnl))
    return {p: charts.equity(paths[p], f"Cumulative result in pips over trades: {p}", own) for p, own in points.items() if p in paths}


@dataclass
class AnalysisSummary:
    """Figures and reports by pair, and what failed."""

    figures: dict[str, dict] = field(default_factory=dict)
    reports: dict[str, Path] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)


def run_backtest_analysis(spark: SparkSession, run_folder: str | Path) -> AnalysisSummary:
    """Performance of every pair of a run: one job for all pairs, then a report each."""
    out, done = Path(run_folder) / "output", AnalysisSummary()
    found = ledgers.discover_paths(spark, out)
    good = {}
    for p, path in found.items():
        try:
            ledgers.load_trades(spark, str(path))
            good[p] = path
        except Exception as wrong:
            done.failures[p] = str(wrong)
    if good:
        rows = ledgers.discover(spark, out).filter(F.col("pair").isin(list(good)))
        drawn = _equity_charts(rows, {p: out / p / "analysis" / "equity.svg" for p in good})
        for r in perf.performance(rows).collect():
            done.figures[r.pair] = r.asDict()
            done.reports[r.pair] = report.performance_report(out / r.pair / "analysis" / "report.md", str(good[r.pair]), r.asDict(), drawn.get(r.pair))
    return done


@dataclass
class StratificationSummary:
    overall: dict
    summaries: dict[str, list[dict]]
    reports: dict[str, Path]
    csv: Path | None


def run_metric_stratification(
    spark: SparkSession,
    trades_path: str | Path | DataFrame,
    output_root: str | Path,
    metrics: Sequence[str] | None = None,
    modes: Sequence[str] = ("scott",),
    min_count: int = 100,
    merge_to_min_count: bool = False,
) -> StratificationSummary:
    """Bins of every metric and mode as CSV (one folder per mode and metric) and Markdown; per metric the first mode's bins."""
    trades = trades_path if isinstance(trades_path, DataFrame) else ledgers.load_trades(spark, str(trades_path))
    names = list(metrics) if metrics is not None else strat.metric_columns(trades, DEFAULT_METRICS)
    table = strat.stratify(trades, names, [strat.Binning(m, min_count=min_count, merge_to_min_count=merge_to_min_count) for m in modes])
    root = Path(output_root)
    root.mkdir(parents=True, exist_ok=True)
    csv = root / "csv"
    table.drop("min_count").repartition(1, "mode", "metric").sortWithinPartitions("mode", "metric", "bin").write.mode("overwrite").partitionBy("mode", "metric").csv(str(csv), header=True)
    rows = [r.asDict() for r in table.orderBy("mode", "metric", "bin").collect()]  # at most 400 bins per metric and mode
    overall = strat.overall(trades, names).first().asDict()
    reports, first, shown, drawn = {}, {}, {}, {}
    for r in strat.plot_rows(table).orderBy("bin").collect():  # at most 400 bins per metric and mode
        shown.setdefault((r["mode"], r["metric"]), []).append(r)
    for (mode, metric), own in shown.items():
        name = "".join(c if c.isalnum() or c in "._-" else "_" for c in metric)
        drawn[mode, metric] = charts.bins(root / "plots" / mode / f"{name}.svg", f"{metric} ({mode})", own)
    for mode in modes:
        own = [r for r in rows if r["mode"] == mode]
        if own:
            reports[mode] = report.stratification_report(root / "reports", mode, sorted({r["metric"] for r in own}), own, {"Backtest": backtest_identifier(root)}, {m: p for (k, m), p in drawn.items() if k == mode})
        for r in own:
            first.setdefault(r["metric"], mode)
    return StratificationSummary(overall, {m: [r for r in rows if r["metric"] == m and r["mode"] == mode] for m, mode in first.items()}, reports, csv if rows else None)


def run_metric_stratification_analysis(spark: SparkSession, run_folder: str | Path, modes: Sequence[str] = ("scott",), min_count: int = 100) -> dict[str, StratificationSummary | str]:
    """Stratification of every pair of a run over the enabled metrics of the run's own copy of its configuration; an error's text where a pair fails."""
    folder = Path(run_folder)
    manifest = json.loads((folder / "manifest.json").read_text())
    enabled = [m.name for m in metrics_config(manifest["configs"]["metrics"]["path"]) if m.enabled]
    out: dict[str, StratificationSummary | str] = {}
    for p, path in ledgers.discover_paths(spark, folder / "output").items():
        try:
            trades = ledgers.load_trades(spark, str(path))
            out[p] = run_metric_stratification(spark, trades, folder / "output" / p / "analysis" / "metric_stratification", strat.metric_columns(trades, enabled), modes, min_count)
        except Exception as wrong:
            out[p] = str(wrong)
    return out


def backtest_identifier(path: Path) -> str:
    """Name of the run that a path lies in: the folder above `output`, else the last folder's name."""
    parts = Path(path).parts
    return parts[parts.index("output") - 1] if "output" in parts[1:] else (parts[-1] if parts else "")


def fingerprint(trades: DataFrame) -> str:
    """Order-free digest of a ledger: two runs agree if theirs do."""
    row = trades.select(F.xxhash64(*[F.col(f"`{c}`") for c in trades.columns]).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{row.n}:{row.s}:{row.x}"


def deterministic(spark: SparkSession, config_path: str | Path, output_root: str | Path) -> bool:
    """Run twice and compare the ledgers."""
    prints = []
    for _ in range(2):
        m = run_backtest(spark, config_path, output_root=output_root)
        prints.append({p: fingerprint(spark.read.parquet(o["trades"])) for p, o in m.get("outputs", {}).items() if o["trades"]})
    return prints[0] == prints[1]
