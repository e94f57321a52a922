"""Metrics: typed parameters, a registry, and their columns over a tick table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, fields
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.errors import ConfigError
from tickspark.operators import kernels
from tickspark.operators.arrow import map_arrow, numpy_of, runs, whole

#: Time constants after which a start value is below the resolution of a double.
TAUS = 40


def number(value, name: str, *, positive: bool = True) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ConfigError(f"'{name}' must be numeric, not {type(value).__name__}")
    if not math.isfinite(value) or (positive and value <= 0):
        raise ConfigError(f"'{name}' must be {'positive and ' if positive else ''}finite, got {value}")
    return float(value)


def whole_number(value, name: str, low: int = 1, high: int | None = None) -> int:
    number(value, name)
    if value != int(value):
        raise ConfigError(f"'{name}' must be an integer, got {value}")
    if value < low or (high is not None and value > high):
        raise ConfigError(f"'{name}' must be at least {low}{f' and at most {high}' if high else ''}, got {value}")
    return int(value)


def price(value) -> str:
    if not isinstance(value, str) or value.lower() not in ("mid", "bid", "ask"):
        raise ConfigError(f"'price_field' must be mid, bid or ask, got {value!r}")
    return value.lower()


@dataclass(frozen=True, kw_only=True)
class Metric:
    """A named metric. Subclasses check their parameters and compute arrays over one instrument's ticks."""

    name: str
    enabled: bool = True
    kind: ClassVar[str] = ""
    outputs: ClassVar[tuple[str, ...]] = ()

    def __post_init__(self) -> None:
        if not isinstance(self.enabled, bool):
            raise ConfigError(f"'{self.name}': 'enabled' must be a boolean")
        self.check()

    def check(self) -> None: ...

    def put(self, name: str, value) -> None:
        object.__setattr__(self, name, value)

    def memory_s(self) -> float:
        """Seconds of history that the value at a tick depends on."""
        return 0.0

    def arrays(self, ticks: Mapping[str, np.ndarray], first: bool) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def columns(self) -> list[str]:
        return [f"{self.name}.{x}" for x in self.outputs]


@dataclass(frozen=True, kw_only=True)
class ZScore(Metric):
    """Residual from the time-weighted rolling mean, and in standard deviations."""

    lookback_seconds: int
    kind: ClassVar[str] = "zscore"
    outputs: ClassVar[tuple[str, ...]] = ("z_score", "rolling_residual")

    def check(self) -> None:
        self.put("lookback_seconds", whole_number(self.lookback_seconds, "lookback_seconds"))

    def memory_s(self) -> float:
        return self.lookback_seconds

    def arrays(self, ticks, first):
        return kernels.zscore(ticks["ts_us"], ticks["mid"], self.lookback_seconds, first, ticks.get("lead_us", 0))


@dataclass(frozen=True, kw_only=True)
class DriftSign(ZScore):
    """Residual from the rolling mean per second of lookback, and its sign."""

    kind: ClassVar[str] = "drift_sign"
    outputs: ClassVar[tuple[str, ...]] = ("drift", "drift_sign")

    def arrays(self, ticks, first):
        return kernels.drift(ticks["ts_us"], ticks["mid"], self.lookback_seconds, first, ticks.get("lead_us", 0))


@dataclass(frozen=True, kw_only=True)
class Ewma(Metric):
    """Exponential average for irregular gaps. initial_value_mode: 'compiled' (default) or 'seeded'."""

    tau_seconds: float
    initial_value: float | None = None
    price_field: str = "mid"
    initial_value_mode: str = "compiled"
    kind: ClassVar[str] = "ewma"
    outputs: ClassVar[tuple[str, ...]] = ("ewma",)

    def check(self) -> None:
        self.put("tau_seconds", number(self.tau_seconds, "tau_seconds"))
        self.put("price_field", price(self.price_field))
        if self.initial_value is not None:
            self.put("initial_value", number(self.initial_value, "initial_value", positive=False))
        if self.initial_value_mode not in ("compiled", "seeded"):
            raise ConfigError("'initial_value_mode' must be compiled or seeded")

    def memory_s(self) -> float:
        return TAUS * self.tau_seconds

    def start(self, first: bool) -> float | None:
        return self.initial_value if first else None

    def average(self, ticks, first) -> np.ndarray:
        x, start = ticks[self.price_field], self.start(first)
        if start is not None and self.initial_value_mode == "seeded":
            # as if the start value had been seen one least gap before the first tick
            ts, v = np.concatenate(([ticks["ts_us"][0] - 1], ticks["ts_us"])), np.concatenate(([start], x))
            return kernels.ewma(ts, v, self.tau_seconds)[1:]
        return kernels.ewma(ticks["ts_us"], x, self.tau_seconds, start)

    def arrays(self, ticks, first):
        return {"ewma": self.average(ticks, first)}


@dataclass(frozen=True, kw_only=True)
class EwmaSlope(Ewma):
    """The average and its slope per second against the oldest average in [t - window, t]."""

    window_seconds: float
    kind: ClassVar[str] = "ewma_slope"
    outputs: ClassVar[tuple[str, ...]] = ("ewma", "slope")

    def check(self) -> None:
        super().check()
        self.put("window_seconds", number(self.window_seconds, "window_seconds"))

    def memory_s(self) -> float:
        return super().memory_s() + self.window_seconds

    def arrays(self, ticks, first):
        y = self.average(ticks, first)
        return {"ewma": y, "slope": kernels.slope_of(ticks["ts_us"], y, self.window_seconds)}


@dataclass(frozen=True, kw_only=True)
class EwmaVol(Metric):
    """Smoothed squared log return and its rank in its own time-weighted history."""

    tau_seconds: float = 1800.0
    percentile_horizon_seconds: float = 1800.0
    bins: int = 256
    base_vol: float = 1e-4
    stddev_cap: float = 5.0
    kind: ClassVar[str] = "ewma_vol"
    outputs: ClassVar[tuple[str, ...]] = ("vol_ewma", "vol_percentile")

    def check(self) -> None:
        for name in ("tau_seconds", "percentile_horizon_seconds", "base_vol", "stddev_cap"):
            self.put(name, number(getattr(self, name), name))
        self.put("bins", whole_number(self.bins, "bins", 2, 10_000))

    def memory_s(self) -> float:
        return TAUS * self.tau_seconds + self.percentile_horizon_seconds

    def arrays(self, ticks, first):
        return kernels.ewma_vol(ticks["ts_us"], ticks["mid"], self.tau_seconds, self.percentile_horizon_seconds, self.bins, self.base_vol, self.stddev_cap, first, ticks.get("lead_us", 0))


@dataclass(frozen=True, kw_only=True)
class Session(Metric):
    """Name of the trading session by UTC hour: a plain column expression."""

    kind: ClassVar[str] = "session"
    outputs: ClassVar[tuple[str, ...]] = ("session_label",)

    @staticmethod
    def column() -> Column:
        hour = F.pmod(F.floor(F.col("ts_us") / 3_600_000_000), F.lit(24))
        label = F.when((hour >= 22) | (hour < 7), "Asia").when(hour < 12, "London").when(hour < 16, "London_New_York_Overlap")
        return label.when(hour < 21, "New_York").otherwise("Other")


@dataclass(frozen=True, kw_only=True)
class Spread(Metric):
    """Spread, in pips, and the share of recent ticks that are not wider."""

    pip_size: float
    window_seconds: float
    kind: ClassVar[str] = "spread"
    outputs: ClassVar[tuple[str, ...]] = ("spread", "spread_pips", "spread_percentile")

    def check(self) -> None:
        for name in ("pip_size", "window_seconds"):
            self.put(name, number(getattr(self, name), name))

    def memory_s(self) -> float:
        return self.window_seconds

    def arrays(self, ticks, first):
        return kernels.spread(ticks["ts_us"], ticks["bid"], ticks["ask"], self.pip_size, self.window_seconds)


@dataclass(frozen=True, kw_only=True)
class TickRate(Metric):
    """Ticks within the window: count, per second, per minute."""

    window_seconds: float
    kind: ClassVar[str] = "tick_rate"
    outputs: ClassVar[tuple[str, ...]] = ("tick_count", "tick_rate_per_sec", "tick_rate_per_min")

    def check(self) -> None:
        self.put("window_seconds", number(self.window_seconds, "window_seconds"))

    def memory_s(self) -> float:
        return self.window_seconds

    def arrays(self, ticks, first):
        return kernels.tick_rate(ticks["ts_us"], self.window_seconds)


@dataclass(frozen=True, kw_only=True)
class ThresholdReversion(Metric):
    """Position of the threshold-reversion machine, as a metric. Sequential: runs per instrument, not in blocks."""

    lookback_seconds: int
    threshold_pips: float
    pip_size: float
    tp_pips: float
    sl_pips: float
    min_recency_seconds: float = 0.0
    trade_timeout_seconds: float | None = None
    kind: ClassVar[str] = "threshold_reversion"
    outputs: ClassVar[tuple[str, ...]] = kernels.Reversion.FIELDS

    def check(self) -> None:
        self.put("lookback_seconds", whole_number(self.lookback_seconds, "lookback_seconds"))
        for name in ("threshold_pips", "pip_size", "tp_pips", "sl_pips"):
            self.put(name, number(getattr(self, name), name))
        if number(self.min_recency_seconds, "min_recency_seconds", positive=False) < 0:
            raise ConfigError("'min_recency_seconds' must not be negative")
        if self.trade_timeout_seconds is not None:
            self.put("trade_timeout_seconds", number(self.trade_timeout_seconds, "trade_timeout_seconds"))

    def memory_s(self) -> float:
        return math.inf

    def machine(self) -> kernels.Reversion:
        """State of an instrument before its first tick; run() goes on from call to call."""
        return kernels.Reversion(self.lookback_seconds, self.threshold_pips, self.tp_pips, self.sl_pips, self.pip_size, self.min_recency_seconds, self.trade_timeout_seconds)

    def arrays(self, ticks, first):
        return self.machine().run(ticks["ts_us"], ticks["mid"])


REGISTRY: dict[str, type[Metric]] = {c.kind: c for c in (ZScore, DriftSign, Ewma, EwmaSlope, EwmaVol, Session, Spread, TickRate, ThresholdReversion)}


def register_metric(cls: type[Metric]) -> type[Metric]:
    """Add a metric type of your own: a Metric with kind, outputs, memory_s() and arrays()."""
    REGISTRY[cls.kind] = cls
    return cls


def make_metric(name: str, kind: str, params: Mapping | None = None, enabled: bool = True) -> Metric:
    """Metric by type name; unknown types and parameters are errors."""
    if kind not in REGISTRY:
        raise ConfigError(f"unknown metric type '{kind}'; known: {sorted(REGISTRY)}")
    known = {f.name for f in fields(REGISTRY[kind])} - {"name", "enabled"}
    if extra := sorted(set(params or {}) - known):
        raise ConfigError(f"metric '{name}' has unexpected parameters {extra}")
    try:
        return REGISTRY[kind](name=name, enabled=enabled, **(params or {}))
    except TypeError as missing:
        raise ConfigError(f"metric '{name}': {missing}") from missing


def with_history(ticks: DataFrame, block_s: float, memory_s: float) -> DataFrame:
    """ticks (with before_us) with block, home (false for history) and lead_us, the time since the tick before (null for the very first).

    A tick also goes, as history, to every later block that may need it. A window holds a sample until its end, which
    lies as far after its time as the tick before lies before it, and all samples after one that it holds. So a tick is
    needed for memory_s after its own time plus the longest gap of its block, or after the latest end of earlier blocks.
    """
    size, memory = int(block_s * 1e6), int(memory_s * 1e6)
    own = ticks.withColumns({"lead_us": F.col("ts_us") - F.col("before_us"), "block": F.floor(F.col("ts_us") / size)})
    ends = F.col("ts_us") + F.coalesce("lead_us", F.lit(0))
    facts = own.groupBy("instrument", "block").agg(F.coalesce(F.max("lead_us"), F.lit(0)).alias("gap"), F.max(ends).alias("end"))
    earlier = Window.partitionBy("instrument").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    facts = facts.select("instrument", "block", "gap", F.max("end").over(earlier).alias("latest"))
    needed = F.greatest(F.col("ts_us") + F.col("gap"), F.col("latest")) + memory + 1_000_000
    dealt = own.join(facts, ["instrument", "block"]).withColumn("home", F.col("block"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.col("home"), F.floor(needed / size))))
    return dealt.withColumn("home", F.col("home") == F.col("block")).drop("gap", "latest")


#: Seconds of a block at least, and least length of a block in memories of its metrics: a fifth of what a task reads is history at most, gaps aside.
WEEK, MEMORIES = 7 * 86_400.0, 4.0


def add_metrics(ticks: DataFrame, metrics: Iterable[Metric], block_s: float | None = None) -> DataFrame:
    """ticks (instrument, seq, ts_us, bid, ask, mid) with the columns `name.output` of every enabled metric.

    Equal parameters are computed once; sessions are a column expression. Metrics of bounded memory go through one
    vectorised pass over blocks of time with their history, so parallelism does not depend on the number of instruments;
    block_s sets the blocks' length (by default a week, or four memories if that is more). Metrics of unbounded memory
    (state machines) follow in a pass over whole instruments in arrival order, piece by piece.
    """
    enabled = [m for m in metrics if m.enabled]
    names = [m.name for m in enabled]
    if len(set(names)) != len(names):
        raise ConfigError(f"metric names repeat: {sorted({n for n in names if names.count(n) > 1})}")
    ordered = [m for m in enabled if not isinstance(m, Session)]
    bounded, endless = ([m for m in ordered if math.isfinite(m.memory_s()) == x] for x in (True, False))
    out, base = ticks, ["instrument", "seq", "ts_us", "bid", "ask", "mid"]
    width = int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "instrument string, seq long, ts_us long, bid double, ask double, mid double"
    made: list[str] = []
    if bounded:
        memory = max(m.memory_s() for m in bounded)
        before = F.col("before_us") if "before_us" in ticks.columns else F.lag("ts_us").over(Window.partitionBy("instrument").orderBy("seq"))
        dealt = with_history(ticks.select(*base, before.alias("before_us")), block_s or max(WEEK, MEMORIES * memory), memory)
        keyed = dealt.select(F.xxhash64("instrument", "block").alias("key"), *base, "home", "lead_us")
        made = [c for m in bounded for c in m.columns()]
        out = keyed.repartition(width, "key").sortWithinPartitions("key", "seq").mapInArrow(_kernel(bounded), kinds + "".join(f", `{c}` double" for c in made))
    if endless:
        keyed = out.select(F.xxhash64("instrument").alias("key"), *base, *[f"`{c}`" for c in made]).repartition(width, "key").sortWithinPartitions("key", "seq")
        schema = kinds + "".join(f", `{c}` double" for c in (*made, *(c for m in endless for c in m.columns())))
        out = map_arrow(keyed, _machines(endless), schema)
    columns = [c for m in ordered for c in m.columns()]
    labels = [Session.column().alias(c) for m in enabled if isinstance(m, Session) for c in m.columns()]
    return out.select(*base, *[F.col(f"`{c}`") for c in columns], *labels) if ordered else out.select("*", *labels)


def _machines(metrics: list[Metric]) -> Callable:
    """Metrics of unbounded memory: one that can go on keeps its state from piece to piece, others get the whole instrument."""

    def run(batches):
        states: list = []
        held: list[pa.RecordBatch] = []
        going = all(hasattr(m, "machine") for m in metrics)

        def done(piece, arrays):
            new = {c: pa.array(values[o], pa.float64()) for m, values in zip(metrics, arrays, strict=True) for c, o in zip(m.columns(), m.outputs, strict=True)}
            return pa.RecordBatch.from_arrays([*piece.columns[1:], *new.values()], names=[*piece.schema.names[1:], *new])

        for piece, first, last in runs(batches):
            if going:
                states = [m.machine() for m in metrics] if first else states
                yield done(piece, [s.run(numpy_of(piece, "ts_us"), numpy_of(piece, "mid")) for s in states])
                continue
            held.append(piece)
            if last:
                table = pa.Table.from_batches(held).combine_chunks()
                held = []
                ticks = {c: numpy_of(table, c) for c in ("ts_us", "bid", "ask", "mid")}
                batch = table.to_batches()[0]
                yield done(batch, [m.arrays(ticks, True) for m in metrics])

    return run


def _kernel(metrics: list[Metric]) -> Callable:
    def run(batches):
        for table in whole(runs(batches)):
            home = table.column("home").to_numpy()
            ticks = {c: numpy_of(table, c) for c in ("ts_us", "bid", "ask", "mid")}
            lead = table.column("lead_us")[0].as_py()
            ticks["lead_us"] = lead or 0
            done: dict[tuple, dict[str, np.ndarray]] = {}
            arrays = []
            for m in metrics:
                key = (type(m), *(getattr(m, f.name) for f in fields(m) if f.name not in ("name", "enabled")))
                if key not in done:
                    done[key] = m.arrays(ticks, lead is None)
                arrays += [pa.array(done[key][o][home], pa.float64()) for o in m.outputs]
            kept = [table.column(c).combine_chunks().filter(pa.array(home)) for c in ("instrument", "seq", "ts_us", "bid", "ask", "mid")]
            out = pa.Table.from_arrays([*kept, *arrays], names=["instrument", "seq", "ts_us", "bid", "ask", "mid", *(c for m in metrics for c in m.columns())])
            yield from out.to_batches(max_chunksize=50_000)

    return run
