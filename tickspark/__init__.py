"""Batch research engine for ordered quote streams, built on Spark DataFrames."""

_PUBLIC = ("run_backtest", "run_backtest_analysis", "run_metric_stratification_analysis", "run_metric_stratification", "run_trade_analysis", "DEFAULT_METRICS", "AnalysisSummary", "StratificationSummary", "TradeAnalysis")


def __getattr__(name: str):
    """Load the public functions when they are asked for."""
    if name in _PUBLIC:
        from tickspark.plans import run

        return getattr(run, name)
    raise AttributeError(name)
