"""Charts as SVG text, which needs no plotting library: equity, bins with their interval, one trade among its ticks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Size of a chart and its margin; points of a line at most.
WIDTH, HEIGHT, MARGIN, POINTS = 960, 420, 56, 1000


class Chart:
    """A canvas with linear axes over finite ranges."""

    def __init__(self, title: str, xs: Sequence[float], ys: Sequence[float]) -> None:
        self.x0, self.x1 = self._span(xs)
        self.y0, self.y1 = self._span(ys)
        escaped = title.replace("&", "&amp;").replace("<", "&lt;")
        self.parts = [f'<text x="{WIDTH / 2}" y="24" text-anchor="middle" font-size="16">{escaped}</text>']
        for k in range(6):
            x, y = self.x0 + k * (self.x1 - self.x0) / 5, self.y0 + k * (self.y1 - self.y0) / 5
            self.parts.append(f'<text x="{self.x(x):.1f}" y="{HEIGHT - MARGIN + 18}" text-anchor="middle" font-size="11">{x:.6g}</text>')
            self.parts.append(f'<text x="{MARGIN - 6}" y="{self.y(y) + 4:.1f}" text-anchor="end" font-size="11">{y:.6g}</text>')
            self.line([(self.x0, y), (self.x1, y)], "#ddd", 0.6)

    @staticmethod
    def _span(values: Sequence[float]) -> tuple[float, float]:
        kept = [v for v in values if v is not None and math.isfinite(v)] or [0.0]
        low, high = min(kept), max(kept)
        return (low, high) if high > low else (low - 0.5, high + 0.5)

    def x(self, v: float) -> float:
        return MARGIN + (v - self.x0) / (self.x1 - self.x0) * (WIDTH - 2 * MARGIN)

    def y(self, v: float) -> float:
        return HEIGHT - MARGIN - (v - self.y0) / (self.y1 - self.y0) * (HEIGHT - 2 * MARGIN)

    def line(self, points: Sequence[tuple[float, float]], colour: str, width: float = 1.4) -> None:
        path = " ".join(f"{self.x(a):.1f},{self.y(b):.1f}" for a, b in points if b is not None and math.isfinite(b))
        self.parts.append(f'<polyline points="{path}" fill="none" stroke="{colour}" stroke-width="{width}"/>')

    def box(self, left: float, right: float, low: float, high: float, colour: str, opacity: float = 1.0) -> None:
        a, b = self.x(left), self.x(right)
        top, bottom = self.y(max(low, high)), self.y(min(low, high))
        self.parts.append(f'<rect x="{a:.1f}" y="{top:.1f}" width="{max(b - a, 0.5):.1f}" height="{max(bottom - top, 0.5):.1f}" fill="{colour}" fill-opacity="{opacity}"/>')

    def mark(self, x: float, y: float, colour: str) -> None:
        self.parts.append(f'<circle cx="{self.x(x):.1f}" cy="{self.y(y):.1f}" r="4" fill="{colour}"/>')

    def save(self, path: Path) -> Path:
        path.parent.mkdir(parents=True, exist_ok=True)
        body = "\n".join(self.parts)
        path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif">\n<rect width="100%" height="100%" fill="white"/>\n{body}\n</svg>\n')
        return path


def thinned(rows: DataFrame, order: str, value: str, by: str = "pair", most: int = POINTS) -> DataFrame:
    """(by, order, value) of at most `most` rows of each `by`: the last of each of so many even stretches of places n."""
    places = rows.groupBy(by).agg(F.max("n").alias("__count"))
    stretch = F.ceil(F.col("n") * most / F.greatest(F.col("__count"), F.lit(most))).cast("long")
    last = rows.join(F.broadcast(places), by).groupBy(by, stretch.alias("__k")).agg(F.max_by(F.struct(order, value), "n").alias("__x"))
    return last.select(by, "__k", "__x.*").orderBy(by, "__k").drop("__k")


def equity(path: Path, title: str, points: Sequence[tuple[float, float]]) -> Path:
    """Cumulative result over trades."""
    chart = Chart(title, [x for x, _ in points], [0.0, *(y for _, y in points)])
    chart.line([(chart.x0, 0.0), (chart.x1, 0.0)], "#888", 0.8)
    chart.line(points, "#1f5fa8")
    return chart.save(path)


def bins(path: Path, title: str, rows: Sequence) -> Path:
    """Mean result per bin as bars with its 95 % interval, the smoothed mean as a line, and the counts as a step below."""
    value = lambda r, k: r[k] if r[k] is not None and math.isfinite(r[k]) else r["avg_pnl"]
    lows, highs = [value(r, "ev_lo") for r in rows], [value(r, "ev_hi") for r in rows]
    chart = Chart(title, [x for r in rows for x in (r["bin_left"], r["bin_right"])], [0.0, *lows, *highs])
    most = max((r["count"] for r in rows), default=1)
    depth = (chart.y1 - chart.y0) * 0.2
    for r, low, high in zip(rows, lows, highs, strict=True):
        chart.box(r["bin_left"], r["bin_right"], chart.y0, chart.y0 + depth * r["count"] / most, "#bbb", 0.6)
        chart.box(r["bin_left"], r["bin_right"], 0.0, r["avg_pnl"], "#2a8f5b" if r["avg_pnl"] >= 0 else "#b5423c", 0.75)
        chart.box(r["bin_left"], r["bin_right"], low, high, "#1f5fa8", 0.15)
    chart.line([(r["bin_center"], r["smoothed"]) for r in rows if r["smoothed"] is not None], "#1f5fa8", 1.8)
    return chart.save(path)


def trade(path: Path, ticks: DataFrame, row, pad_points: int = POINTS) -> Path:
    """Mid around one trade, with entry and exit; of more ticks than pad_points every so many-th stands."""
    some = ticks.select("ts_us", "mid").withColumn("n", F.row_number().over(Window.orderBy("ts_us")))  # the window around one trade
    step = max(1, -(-some.count() // pad_points))
    points = [((r.ts_us / 1e6), r.mid) for r in some.filter(F.col("n") % step == 0).orderBy("n").collect()]
    start = points[0][0] if points else 0.0
    entry, exit_ = ((getattr(row, c).timestamp() - start) for c in ("entry_time", "exit_time"))
    chart = Chart(f"{row.pair}: {row.outcome_label}, {row.pnl_pips:.2f} pips", [*(x - start for x, _ in points), entry, exit_], [*(y for _, y in points), row.entry_price, row.exit_price])
    chart.line([(x - start, y) for x, y in points], "#1f5fa8")
    chart.mark(entry, row.entry_price, "#2a8f5b")
    chart.mark(exit_, row.exit_price, "#b5423c")
    return chart.save(path)
