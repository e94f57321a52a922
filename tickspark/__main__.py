"""Command line: run, analyse, stratify, sweep-build, sweep-run, sweep-summary. Works under spark-submit."""

from __future__ import annotations

import argparse
import json

from tickspark.plans import run, sweep_files
from tickspark.session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tickspark")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("run", help="run a backtest, its analysis and its stratification")
    c.add_argument("config")
    c.add_argument("--output-root")
    c.add_argument("--run-id")
    c.add_argument("--log-level", default="INFO")
    c.add_argument("--block-seconds", type=float)
    c.add_argument("--documented-exit", action="store_true", help="an exit without predicates never closes")
    c.add_argument("--explain", action="store_true")
    c.add_argument("--profile", action="store_true", help="write calls, plan and stage times into the run's folder")
    c.add_argument("--no-analysis", action="store_true")
    c = commands.add_parser("analyse", help="performance of a ledger")
    c.add_argument("trades")
    c.add_argument("--report")
    c = commands.add_parser("stratify", help="bins of a ledger's metrics")
    c.add_argument("trades")
    c.add_argument("output")
    c.add_argument("--metrics", nargs="*")
    c.add_argument("--modes", nargs="+", default=["scott"])
    c.add_argument("--min-count", type=int, default=100)
    c.add_argument("--merge", action="store_true")
    c = commands.add_parser("sweep-build", help="write the grid's strategies")
    c.add_argument("strategy")
    c.add_argument("folder")
    c = commands.add_parser("sweep-run", help="run a manifest's strategies that have not completed")
    c.add_argument("manifest")
    c.add_argument("config")
    c.add_argument("output")
    c = commands.add_parser("sweep-summary", help="results per configuration and pair")
    c.add_argument("manifest")
    c.add_argument("output")
    a = p.parse_args(argv)
    spark = session()
    if a.command == "run":
        made = run.run_backtest(spark, a.config, output_root=a.output_root, run_id=a.run_id, log_level=a.log_level, block_s=a.block_seconds, empty_exit_closes=not a.documented_exit, explain=a.explain, profile=a.profile)
        print(json.dumps({k: made.get(k) for k in ("run_id", "status", "outputs", "pair_failures")}, indent=2, default=str))
        if not a.no_analysis:
            from pathlib import Path

            folder = Path(made["output_root"]).parent
            run.run_backtest_analysis(spark, folder)
            run.run_metric_stratification_analysis(spark, folder)
        return int(made["status"] != "completed")
    if a.command == "analyse":
        print(run.run_trade_analysis(spark, a.trades, a.report).report)
    elif a.command == "stratify":
        print(run.run_metric_stratification(spark, a.trades, a.output, a.metrics, a.modes, a.min_count, a.merge).reports)
    elif a.command == "sweep-build":
        print(sweep_files.build(spark, a.strategy, a.folder))
    elif a.command == "sweep-run":
        print(json.dumps(sweep_files.run_all(spark, a.manifest, a.config, a.output), indent=2))
    else:
        sweep_files.summarise(spark, a.manifest, a.output).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
