"""Sweep files: strategy configurations of a grid, their manifest, and resumable runs."""

from __future__ import annotations

import copy
import csv
import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.plans import sweep
from tickspark.plans.run import run_backtest
from tickspark.sources import trades as ledgers

COLUMNS = ("label", "strategy_config_path", "min_recency_seconds", "tp_pips", "sl_pips", "trade_timeout_seconds")


def build(spark: SparkSession, base_strategy: str | Path, folder: str | Path) -> Path:
    """Write one strategy per grid row, each the base with the row's parameters, and manifest.csv."""
    base = yaml.safe_load(Path(base_strategy).read_text())
    if base["strategy"]["entry"]["engine"] != "threshold_reversion":
        raise ValueError("the base strategy must use the threshold_reversion engine")
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    with (out / "manifest.csv").open("w", newline="") as f:
        rows = csv.DictWriter(f, COLUMNS)
        rows.writeheader()
        for c in sweep.grid(spark).collect():
            own = copy.deepcopy(base)
            own["strategy"]["entry"]["params"] |= {k: c[k] for k in COLUMNS[2:]}
            path = out / f"{c.label}.yaml"
            path.write_text(yaml.safe_dump(own, sort_keys=False))
            rows.writerow({"label": c.label, "strategy_config_path": str(path), **{k: c[k] for k in COLUMNS[2:]}})
    return out / "manifest.csv"


def run_all(spark: SparkSession, manifest: str | Path, backtest_config: str | Path, output_root: str | Path) -> dict[str, str]:
    """Run every configuration of a manifest that has no completed run below output_root: label -> ok, skipped, partial or failed."""
    out, base = Path(output_root), yaml.safe_load(Path(backtest_config).read_text())
    done = {}
    for row in csv.DictReader(Path(manifest).open()):
        own = out / row["label"]
        state = json.loads((own / "manifest.json").read_text()) if (own / "manifest.json").exists() else {}
        if state.get("status") == "completed":
            done[row["label"]] = "skipped"
            continue
        config = out / "configs" / f"{row['label']}.yaml"
        config.parent.mkdir(parents=True, exist_ok=True)
        config.write_text(yaml.safe_dump(base | {"strategy_config_path": row["strategy_config_path"]}, sort_keys=False))
        try:
            made = run_backtest(spark, config, output_root=out, run_id=row["label"], log_level="WARNING")
            done[row["label"]] = "partial" if made.get("pair_failures") else "ok"
        except Exception:
            done[row["label"]] = "failed"
    return done


def summarise(spark: SparkSession, manifest: str | Path, output_root: str | Path) -> DataFrame:
    """Trades and mean result per configuration and pair of the runs that have ledgers, one job for all."""
    paths = [str(p) for label in (r["label"] for r in csv.DictReader(Path(manifest).open())) for p in ledgers.discover_paths(spark, Path(output_root) / label / "output").values()]
    if not paths:
        raise FileNotFoundError("no completed runs")
    rows = spark.read.option("mergeSchema", "true").parquet(*paths)
    label = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/output/[^/]+/trades\.parquet", 1)
    params = ledgers.read_manifest(spark, str(manifest)).drop("strategy_config_path")
    return sweep.summary(rows.select("pair", "pnl_pips", label.alias("label")).join(params, "label"))
