"""Signals and the one-position trade ledger."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.operators import kernels
from tickspark.operators.arrow import map_arrow, numpy_of, runs
from tickspark.operators.engines import META, EwmaCrossoverParams, StubParams, ThresholdReversionParams, arrival, in_order
from tickspark.operators.predicates import Predicate, all_hold, number


@dataclass(frozen=True, kw_only=True)
class Strategy:
    """Entry engine with predicates, and an exit rule. empty_exit_closes: an exit without predicates closes at once."""

    name: str
    entry_name: str
    engine: str
    params: object
    entry_predicates: tuple[Predicate, ...] = ()
    exit_name: str = "default_exit"
    exit_predicates: tuple[Predicate, ...] = ()
    empty_exit_closes: bool = True


#: What runs when no strategy is given.
NO_STRATEGY = Strategy(name="stub", entry_name="stub", engine="stub", params=StubParams())


def live(ticks: DataFrame, warmup_s: float) -> DataFrame:
    """ticks with `live`: false through the first tick that is warmup_s or more after the instrument's first one."""
    so_far = arrival().rowsBetween(Window.unboundedPreceding, 0)
    before = arrival().rowsBetween(Window.unboundedPreceding, -1)
    reached = (F.col("ts_us") - F.first("ts_us").over(so_far)) >= F.lit(max(0.0, warmup_s) * 1e6)
    return ticks.withColumn("__reached", reached).withColumn("live", F.coalesce(F.max("__reached").over(before), F.lit(False))).drop("__reached")


def signals(metrics: DataFrame, strategy: Strategy, pip_size: float, warmup_s: float) -> DataFrame:
    """Metric rows with live, intents (sig_*), should_open, should_close and reason.

    Predicates filter after the engine has run, so a blocked intent is used up. Nothing opens or closes in the warm-up.
    """
    # one exchange for the windows, the engine and the ledger; a fixed number of partitions keeps the Python passes parallel
    dealt = decided(metrics, strategy).repartition(int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions")), "instrument")
    intents = strategy.params.apply(live(dealt, warmup_s), pip_size)
    reason = F.when(F.col("sig_open") & ~F.col("entry_ok"), "entry_predicate_blocked").otherwise(strategy.entry_name)
    return intents.withColumns({"should_open": F.col("sig_open") & F.col("entry_ok") & F.col("live"), "should_close": F.col("exit_ok") & F.col("live"), "reason": reason}).drop("entry_ok", "exit_ok")


LEDGER = (
    ("signal_seq", "long", pa.int64()), ("signal_us", "long", pa.int64()), ("fill_us", "long", pa.int64()), ("exit_us", "long", pa.int64()), ("direction", "int", pa.int32()),
    ("entry_price", "double", pa.float64()), ("exit_price", "double", pa.float64()), ("pnl_pips", "double", pa.float64()), ("holding_seconds", "double", pa.float64()),
    ("outcome_label", "string", pa.string()), ("timeout", "double", pa.float64()), ("signal_price", "double", pa.float64()), ("tp", "double", pa.float64()), ("sl", "double", pa.float64()), ("threshold", "double", pa.float64()),
)


class Signalled:
    """Signals of one instrument that stand in its rows already."""

    COLUMNS = ("instrument", "seq", "ts_us", "mid", "should_open", "sig_direction", "sig_tp", "sig_sl", "sig_timeout", "sig_threshold", "should_close", "live")

    def __call__(self, piece: pa.RecordBatch) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        """The piece, and what the ledger is fed of its live rows: seq, time, mid, opens, direction, tp, sl, timeout, threshold, closes."""
        get = [numpy_of(piece, c) for c in self.COLUMNS[1:]]
        alive = np.flatnonzero(get.pop())
        start = alive[0] if len(alive) else len(get[0])
        return piece, [v[start:] for v in get]


class Reverting:
    """Signals of one instrument from the threshold-reversion machine, whose state it holds between pieces."""

    COLUMNS = ("instrument", "seq", "ts_us", "mid", "entry_ok", "exit_ok")

    def __init__(self, params, pip_size: float, warmup_s: float) -> None:
        self.machine = kernels.Reversion(params.lookback_seconds, params.threshold_pips, params.tp_pips, params.sl_pips, pip_size, params.min_recency_seconds, params.trade_timeout_seconds)
        self.timeout = params.trade_timeout_seconds or math.nan
        self.warm = WarmUp(warmup_s)

    def __call__(self, piece: pa.RecordBatch) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        seq, ts, mid, entry_ok, exit_ok = (numpy_of(piece, c) for c in self.COLUMNS[1:])
        n = len(seq)
        at, fields = self.machine.edges(ts, mid)
        spread = lambda values: _put(n, at, values)
        direction, opens = np.zeros(n, np.int32), np.zeros(n, bool)
        direction[at] = fields["position"].astype(np.int32)
        opens[at] = entry_ok[at]  # a blocked edge is used up
        metas = {f"meta_{x}": pa.array(spread(fields[x])) for x in META["threshold_reversion"]}
        start = self.warm(ts)
        fed = [seq, ts, mid, opens, direction, spread(fields["tp_price"]), spread(fields["sl_price"]), np.full(n, self.timeout), np.full(n, self.machine.threshold), exit_ok]
        return pa.RecordBatch.from_arrays([*piece.columns, *metas.values()], names=[*piece.schema.names, *metas]), [v[start:] for v in fed]


class Crossing:
    """Signals of one instrument where fast - slow changes sign; the last difference and the warm-up are carried between pieces."""

    COLUMNS = ("instrument", "seq", "ts_us", "mid", "entry_ok", "exit_ok", "meta_fast", "meta_slow")

    def __init__(self, params, pip_size: float, warmup_s: float) -> None:
        self.params, self.pip, self.warm, self.last = params, pip_size, WarmUp(warmup_s), math.nan

    def __call__(self, piece: pa.RecordBatch) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        seq, ts, mid, entry_ok, exit_ok, fast, slow = (numpy_of(piece, c) for c in self.COLUMNS[1:])
        n, p = len(seq), self.params
        with np.errstate(invalid="ignore"):
            diff = np.where(np.isfinite(fast) & np.isfinite(slow), fast - slow, np.nan)
        before = np.concatenate(([self.last], diff[:-1]))
        self.last = diff[-1]
        direction = np.zeros(n, np.int32)
        if p.short_on_cross:
            direction[(diff <= 0) & (before > 0)] = -1
        if p.long_on_cross:
            direction[(diff >= 0) & (before < 0)] = 1
        level = lambda pips, sign: np.where((direction != 0) & (pips > 0), mid + sign * direction * pips * self.pip, np.nan)
        opens = (direction != 0) & entry_ok
        start = self.warm(ts)
        fed = [seq, ts, mid, opens, direction, level(p.tp_pips, 1), level(p.sl_pips, -1), np.full(n, p.trade_timeout_seconds or math.nan), np.full(n, math.nan), exit_ok]
        return pa.RecordBatch.from_arrays([*piece.columns, pa.array(diff, from_pandas=True)], names=[*piece.schema.names, "meta_diff"]), [v[start:] for v in fed]


class WarmUp:
    """Finds the first live tick of pieces: the one after the first that is warmup_s or more after the instrument's first."""

    def __init__(self, warmup_s: float) -> None:
        self.warm_us, self.begin, self.live = max(0.0, warmup_s) * 1e6, None, False

    def __call__(self, ts: np.ndarray) -> int:
        if self.live:
            return 0
        self.begin = ts[0] if self.begin is None else self.begin
        reached = np.flatnonzero(ts - self.begin >= self.warm_us)
        self.live = len(reached) > 0
        return int(reached[0]) + 1 if self.live else len(ts)


def _put(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(n, math.nan)
    out[at] = values
    return out


def ledger_pass(signals_of, multiples: tuple, exit_name: str, pip_size: float, kept: list[str]):
    """One pass over ordered pieces: signals_of() gives an instrument's signals, and one open trade per instrument is the state."""

    def run(batches):
        source, ledger, at_signal = None, None, None
        for raw, first, last in runs(batches):
            if first:
                source, ledger, at_signal = signals_of(), kernels.Ledger(pip_size, exit_name, *multiples), None
            piece, fed = source(raw)
            done = ledger.feed(*fed)
            if last:
                done = done + ledger.finish()
            here = numpy_of(piece, "seq")

            def rows_of(closed_trades, piece=piece, here=here, carried=at_signal):
                """Rows at the trades' signals, in order; only the first can have been signalled in an earlier piece."""
                wanted = np.array([t["signal_seq"] for t in closed_trades], np.int64)
                at = np.minimum(np.searchsorted(here, wanted), len(here) - 1)
                late = 0 if here[at[0]] == wanted[0] else 1
                taken = piece.take(pa.array(at[late:]))
                return pa.Table.from_batches([carried, taken] if late else [taken]).combine_chunks()

            if done:
                rows = rows_of(done)
                columns = [rows.column("instrument").combine_chunks()]
                columns += [pa.array([t[n] for t in done], kind) for n, _, kind in LEDGER]
                columns += [rows.column(c).combine_chunks() for c in kept]
                yield pa.RecordBatch.from_arrays(columns, names=["instrument", *(n for n, _, _ in LEDGER), *kept])
            at_signal = rows_of([ledger.trade]).to_batches()[0] if ledger.trade else None

    return run


def trades(signalled: DataFrame, strategy: Strategy, pip_size: float, metric_columns: list[str] | None = None) -> DataFrame:
    """The ledger: one row per closed trade, with the metrics at its signal.

    signalled comes from signals(), whose rows are already whole per instrument and in arrival order; the ledger keeps
    one open trade per instrument as its state, so nothing is shuffled or gathered again.
    """
    captured = metric_columns if metric_columns is not None else [c for c in signalled.columns if "." in c]
    metas = [f"meta_{x}" for x in META.get(strategy.engine, ()) if f"meta_{x}" in signalled.columns]
    kinds = {f.name: f.dataType.simpleString() for f in signalled.schema.fields}
    needed = signalled.select(*Signalled.COLUMNS, *[f"`{c}`" for c in (*captured, *metas)])
    return _told(needed, Signalled, strategy, pip_size, captured, metas, kinds)


def _told(needed: DataFrame, signals_of, strategy: Strategy, pip_size: float, captured: list[str], metas: list[str], kinds: dict[str, str]) -> DataFrame:
    kept = [*captured, *metas]
    schema = "instrument string, " + ", ".join(f"{n} {k}" for n, k, _ in LEDGER) + "".join(f", `{c}` {kinds[c]}" for c in kept)
    closed = map_arrow(needed, ledger_pass(signals_of, strategy.params.multiples(), strategy.exit_name, pip_size, kept), schema)
    time = lambda c: F.timestamp_micros(c)
    none = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c))
    metadata = F.struct(
        none("threshold").alias("threshold"), none("tp").alias("tp_price"), none("sl").alias("sl_price"),
        *[F.col(m).alias(m[5:]) for m in metas if m not in ("meta_tp_price", "meta_sl_price")],
        F.col("direction").alias("direction"), F.col("signal_price").alias("signal_price"), none("timeout").alias("trade_timeout_seconds"),
    )
    return closed.select(
        F.col("instrument").alias("pair"), time("fill_us").alias("entry_time"), time("exit_us").alias("exit_time"), time("fill_us").alias("timestamp_entry"), time("exit_us").alias("timestamp_exit"),
        "direction", "entry_price", "exit_price", "pnl_pips", "holding_seconds", "outcome_label", F.lit(strategy.entry_name).alias("reason"),
        *([F.struct(*[F.col(f"`{c}`").alias(c) for c in captured]).alias("entry_metrics")] if captured else []), *[F.col(f"`{c}`") for c in captured],
        none("timeout").alias("timeout_seconds"), time("signal_us").alias("signal_timestamp"), "signal_price", metadata.alias("entry_metadata"), "signal_seq",
    )


def decided(metrics: DataFrame, strategy: Strategy) -> DataFrame:
    """metrics with entry_ok and exit_ok: what the strategy's predicates say of each row."""
    exit_ok = F.lit(False) if not strategy.exit_predicates and not strategy.empty_exit_closes else all_hold(strategy.exit_predicates, metrics.schema)
    return metrics.withColumns({"entry_ok": all_hold(strategy.entry_predicates, metrics.schema), "exit_ok": exit_ok})


def run_strategy(metrics: DataFrame, strategy: Strategy, pip_size: float, warmup_s: float) -> DataFrame:
    """The ledger of a strategy: the engines of the library with signals and ledger in one pass over the ordered ticks, others by signals() and trades()."""
    captured, params = [c for c in metrics.columns if "." in c], strategy.params
    source = {ThresholdReversionParams: Reverting, EwmaCrossoverParams: Crossing}.get(type(params))
    if source is not None:
        told = decided(metrics, strategy)
        if source is Crossing:
            told = told.withColumns({f"meta_{x}": number(name, metrics.schema) for x, name in (("fast", params.fast_metric), ("slow", params.slow_metric))})
        needed = in_order(told.select(*source.COLUMNS, *[f"`{c}`" for c in captured]))
        metas = [f"meta_{x}" for x in META[strategy.engine]]
        kinds = {f.name: f.dataType.simpleString() for f in metrics.schema.fields} | dict.fromkeys(metas, "double")
        return _told(needed, lambda: source(params, pip_size, warmup_s), strategy, pip_size, captured, metas, kinds)
    return trades(signals(metrics, strategy, pip_size, warmup_s), strategy, pip_size, captured)


def close_label(exit_price: float, tp: float | None, sl: float | None, tolerance: float = 0.0) -> str:
    """Label of a close for which no reason was given: TP, SL or EXIT by the price it was closed at."""
    for label, level in (("TP", tp), ("SL", sl)):
        if level is not None and math.isfinite(level) and abs(exit_price - level) <= tolerance:
            return label
    return "EXIT"
