"""Entry engines: each turns metric rows into open intents (sig_* columns)."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.errors import ConfigError
from tickspark.operators import kernels
from tickspark.operators.arrow import map_arrow, numpy_of, runs
from tickspark.operators.metrics import number as checked
from tickspark.operators.metrics import whole_number
from tickspark.operators.predicates import number
from tickspark.operators.validate import finite

#: Columns that an engine adds; tp, sl, timeout and threshold are NaN where there is none.
INTENT = ("sig_open", "sig_direction", "sig_tp", "sig_sl", "sig_timeout", "sig_threshold")
META = {"threshold_reversion": ("reference_price", "tp_price", "sl_price", "reference_age_seconds", "position_open_age_seconds"), "ewma_crossover": ("fast", "slow", "diff"), "stub": ()}


def arrival():
    """An instrument's ticks in arrival order."""
    return Window.partitionBy("instrument").orderBy("seq")


def in_order(ticks: DataFrame) -> DataFrame:
    """ticks with each instrument whole in one partition, in arrival order: what the sequential passes need."""
    width = int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ticks.repartition(width, "instrument").sortWithinPartitions("instrument", "seq")


def _positive(value, name: str) -> float:
    return checked(value, name)


def _not_negative(value, name: str) -> float:
    if checked(value, name, positive=False) < 0:
        raise ConfigError(f"'{name}' must not be negative, got {value}")
    return float(value)


@dataclass(frozen=True, kw_only=True)
class ThresholdReversionParams:
    lookback_seconds: int
    threshold_pips: float
    tp_pips: float | None = None
    sl_pips: float | None = None
    min_recency_seconds: float = 0.0
    trade_timeout_seconds: float | None = None

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("lookback_seconds", whole_number(self.lookback_seconds, "lookback_seconds"))
        put("threshold_pips", _positive(self.threshold_pips, "threshold_pips"))
        for k in ("tp_pips", "sl_pips"):
            put(k, self.threshold_pips if getattr(self, k) is None else _positive(getattr(self, k), k))
        put("min_recency_seconds", _not_negative(self.min_recency_seconds, "min_recency_seconds"))
        if self.trade_timeout_seconds is not None:
            put("trade_timeout_seconds", _positive(self.trade_timeout_seconds, "trade_timeout_seconds"))

    def multiples(self) -> tuple[float | None, float | None]:
        return self.tp_pips / self.threshold_pips, self.sl_pips / self.threshold_pips

    def apply(self, df: DataFrame, pip_size: float) -> DataFrame:
        return reversion_intents(in_order(df), self, pip_size)


@dataclass(frozen=True, kw_only=True)
class EwmaCrossoverParams:
    fast_metric: str
    slow_metric: str
    long_on_cross: bool = True
    short_on_cross: bool = False
    tp_pips: float = 0.0
    sl_pips: float = 0.0
    trade_timeout_seconds: float | None = None

    def __post_init__(self) -> None:
        for k in ("fast_metric", "slow_metric"):
            if not isinstance(getattr(self, k), str) or not getattr(self, k):
                raise ConfigError(f"'{k}' must be a non-empty string")
        for k in ("long_on_cross", "short_on_cross"):
            if not isinstance(getattr(self, k), bool):
                raise ConfigError(f"'{k}' must be a boolean")
        for k in ("tp_pips", "sl_pips"):
            object.__setattr__(self, k, _not_negative(getattr(self, k), k))
        if self.trade_timeout_seconds is not None:
            object.__setattr__(self, "trade_timeout_seconds", _positive(self.trade_timeout_seconds, "trade_timeout_seconds"))

    def multiples(self) -> tuple[float | None, float | None]:
        return None, None

    def apply(self, df: DataFrame, pip_size: float) -> DataFrame:
        """Long where fast - slow reaches 0 from below, short where it reaches 0 from above; a gap in either forgets the last difference."""
        fast, slow = number(self.fast_metric, df.schema), number(self.slow_metric, df.schema)
        diff = F.when(finite(fast) & finite(slow), fast - slow)
        with_diff = df.withColumns({"meta_fast": fast, "meta_slow": slow, "meta_diff": diff}).withColumn("__last", F.lag("meta_diff").over(arrival()))
        up = F.lit(self.long_on_cross) & (F.col("meta_diff") >= 0) & (F.col("__last") < 0)
        down = F.lit(self.short_on_cross) & (F.col("meta_diff") <= 0) & (F.col("__last") > 0)
        direction = F.when(F.coalesce(up, F.lit(False)), 1).when(F.coalesce(down, F.lit(False)), -1).otherwise(0)
        level = lambda pips, sign: F.when((F.col("sig_direction") != 0) & F.lit(pips > 0), F.col("mid") + sign * F.col("sig_direction") * pips * pip_size).otherwise(math.nan)
        out = with_diff.withColumn("sig_direction", direction).withColumns({
            "sig_open": F.col("sig_direction") != 0, "sig_tp": level(self.tp_pips, 1), "sig_sl": level(self.sl_pips, -1),
            "sig_timeout": F.lit(self.trade_timeout_seconds or math.nan).cast("double"), "sig_threshold": F.lit(math.nan),
        })
        return out.drop("__last")


@dataclass(frozen=True, kw_only=True)
class StubParams:
    """Never opens."""

    def multiples(self) -> tuple[float | None, float | None]:
        return None, None

    def apply(self, df: DataFrame, pip_size: float) -> DataFrame:
        nan = F.lit(math.nan)
        return df.withColumns({"sig_open": F.lit(False), "sig_direction": F.lit(0), "sig_tp": nan, "sig_sl": nan, "sig_timeout": nan, "sig_threshold": nan})


ENGINES: dict[str, type] = {"threshold_reversion": ThresholdReversionParams, "ewma_crossover": EwmaCrossoverParams, "stub": StubParams}


def register_engine(name: str, params: type) -> None:
    """Add an engine: a parameter class with multiples() and apply(df, pip_size)."""
    ENGINES[name] = params


def make_params(engine: str, params: Mapping | None):
    if engine not in ENGINES:
        raise ConfigError(f"unknown entry engine '{engine}'; known: {sorted(ENGINES)}")
    known = {f.name for f in fields(ENGINES[engine])}
    if extra := sorted(set(params or {}) - known):
        raise ConfigError(f"engine '{engine}' has unexpected parameters {extra}")
    try:
        return ENGINES[engine](**(params or {}))
    except TypeError as missing:
        raise ConfigError(f"engine '{engine}': {missing}") from missing


def reversion_intents(ordered: DataFrame, params: ThresholdReversionParams, pip_size: float) -> DataFrame:
    """Reversion columns (meta_*) and intents. An intent is a position that differs from the tick before and from 0.

    One pass over each instrument in arrival order with bounded state; predicates play no part, so a blocked edge is
    used up.
    """
    added = ["meta_position", *(f"meta_{x}" for x in META["threshold_reversion"]), "sig_direction", "sig_tp", "sig_sl"]
    kinds = ["double"] * (len(added) - 3) + ["int", "double", "double"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    timeout = params.trade_timeout_seconds if params.trade_timeout_seconds and params.trade_timeout_seconds > 0 else math.nan

    def run(batches):
        machine, before = None, 0.0
        for piece, first, _ in runs(batches, key=piece_key):
            if first:
                machine, before = kernels.Reversion(params.lookback_seconds, params.threshold_pips, params.tp_pips, params.sl_pips, pip_size, params.min_recency_seconds, params.trade_timeout_seconds), 0.0
            values = machine.run(numpy_of(piece, "ts_us"), numpy_of(piece, "mid"))
            position = values["position"]
            edge = (position != 0) & (position != np.concatenate(([before], position[:-1])))
            before = position[-1]
            arrays = [pa.array(position)] + [pa.array(values[x]) for x in META["threshold_reversion"]]
            arrays += [pa.array(np.where(edge, position, 0).astype(np.int32)), pa.array(values["tp_price"]), pa.array(values["sl_price"])]
            yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], names=[*piece.schema.names, *added])

    piece_key = ordered.columns.index("instrument")
    out = map_arrow(ordered, run, schema + ", " + ", ".join(f"{n} {k}" for n, k in zip(added, kinds, strict=True)))
    return out.withColumns({"sig_open": F.col("sig_direction") != 0, "sig_timeout": F.lit(timeout), "sig_threshold": F.lit(params.threshold_pips * pip_size)})
