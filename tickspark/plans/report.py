"""Markdown reports."""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime, timedelta
from pathlib import Path

#: Label, figure, digits (None: a count; "%": a share; "min": minutes; "span": a duration).
LINES = (
    ("Total trades", "total_trades", None), ("Winning trades", "winning_trades", None), ("Losing trades", "losing_trades", None), ("Breakeven trades", "breakeven_trades", None), ("Win rate", "win_rate", "%"),
    ("Net PnL (pips)", "net_pnl_pips", 2), ("Gross profit (pips)", "gross_profit_pips", 2), ("Gross loss (pips)", "gross_loss_pips", 2), ("Profit factor", "profit_factor", 3), ("Expectancy (pips/trade)", "expectancy_pips", 3),
    ("Average trade (pips)", "avg_trade_pips", 3), ("Average win (pips)", "avg_win_pips", 3), ("Average loss (pips)", "avg_loss_pips", 3), ("Median trade (pips)", "median_trade_pips", 3), ("Best trade (pips)", "best_trade_pips", 3),
    ("Worst trade (pips)", "worst_trade_pips", 3), ("Avg holding time", "avg_holding_minutes", "min"), ("Per-trade Sharpe", "per_trade_sharpe", 3), ("Daily Sharpe (annualised)", "daily_sharpe", 3), ("Daily return mean", "daily_return_mean", 3),
    ("Daily return stdev", "daily_return_std", 3), ("Sampled trading days", "sampled_days", None), ("Max drawdown (pips)", "max_drawdown_pips", 3), ("Max drawdown duration", "max_drawdown_seconds", "span"),
)


def shown(value, kind) -> str:
    if kind is None:
        return f"{value or 0:,}"
    if value is None or math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "∞"
    if kind == "%":
        return f"{value * 100:.2f}%"
    if kind == "min":
        return f"{value:.2f} min"
    return str(timedelta(seconds=value)) if kind == "span" else f"{value:.{kind}f}"


def formatted(figures: Mapping) -> list[tuple[str, str]]:
    """(label, text) of one row of performance()."""
    return [(label, shown(figures.get(key), kind)) for label, key, kind in LINES]


def _link(chart: Path | None, path: Path, what: str) -> list[str]:
    """Lines that show a chart in a report, by a path relative to it."""
    return ["", f"![{what}]({os.path.relpath(chart, path.parent)})"] if chart else []


def performance_report(path: Path, trades: str, figures: Mapping, chart: Path | None = None) -> Path:
    lines = ["# Trade Performance Report", "", f"**Trades file:** `{trades}`", f"**Trade count:** {figures['total_trades']:,}", "", "## Key Metrics", ""]
    lines += [f"- **{label}:** {text}" for label, text in formatted(figures)]
    lines += _link(chart, path, "Equity curve")
    lines += ["", "## Notes", "", "- Per-trade Sharpe takes each trade as one observation; the daily figure takes the equity at the end of each day, over 252 days a year."]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return path


def stratification_report(folder: Path, mode: str, metrics: Iterable[str], rows: Iterable[Mapping], about: Mapping[str, str] | None = None, charts: Mapping[str, Path] | None = None) -> Path:
    """One report per binning mode: a table of bins for each metric."""
    names = list(metrics)
    if not names:
        raise ValueError(f"no metrics for mode '{mode}'")
    grouped: dict[str, list[Mapping]] = {n: [] for n in names}
    for r in rows:
        grouped.setdefault(r["metric"], []).append(r)
    lines = [f"# Metric Stratification Report – {mode}", "", f"_Generated {datetime.now(UTC):%Y-%m-%d %H:%M:%SZ}_", "", f"- Binning mode: `{mode}`", f"- Metrics included: {len(names)}"]
    lines += [f"- {k}: {v}" for k, v in sorted((about or {}).items())]
    for name in names:
        lines += ["", f"## `{name}` ({mode})", "", "| bin | count | avg pnl | 95 % low | 95 % high | win rate |", "|-|-|-|-|-|-|"]
        num = lambda x: "" if x is None else f"{x:.4g}"
        lines += [f"| ({r['bin_left_label']:g}, {r['bin_right_label']:g}] | {r['count']} | {num(r['avg_pnl'])} | {num(r['ev_lo'])} | {num(r['ev_hi'])} | {num(r['win_rate'])} |" for r in grouped[name]]
        lines += _link((charts or {}).get(name), folder / "report.md", f"Bins of {name}")
    path = folder / f"metric_report_{mode}.md"
    folder.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return path
