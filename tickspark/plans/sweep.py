"""Parameter sweeps of the threshold-reversion engine: a grid as a table, all runs in one plan."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.operators import engines, kernels, simulate
from tickspark.operators.arrow import runs
from tickspark.operators.predicates import Predicate

#: The standard grid: 5 x 4 x 4.
RECENCY, TP_SL, TIMEOUT = (0, 30, 60, 90, 120), ((10, 10), (8, 8), (6, 6), (12, 12)), (60, 120, 180, 300)


def grid(spark: SparkSession, min_recency_seconds: Sequence[int] = RECENCY, tp_sl: Sequence[tuple[int, int]] = TP_SL, trade_timeout_seconds: Sequence[int] = TIMEOUT) -> DataFrame:
    """(label, min_recency_seconds, tp_pips, sl_pips, trade_timeout_seconds): every combination; its size is that of the lists."""
    exploded = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    base = spark.range(1).select(exploded("min_recency_seconds", min_recency_seconds))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("tp_pips"), F.lit(b).alias("sl_pips")) for a, b in tp_sl]))
    rows = base.withColumn("p", pairs).select("min_recency_seconds", "p.*").select("*", exploded("trade_timeout_seconds", trade_timeout_seconds))
    label = F.format_string("min%d_tp%d_sl%d_timeout%d", "min_recency_seconds", "tp_pips", "sl_pips", "trade_timeout_seconds")
    return rows.select(label.alias("label"), "min_recency_seconds", "tp_pips", "sl_pips", "trade_timeout_seconds")


#: Configurations that one task runs beside each other over an instrument's ticks.
TOGETHER = 10
PARAMETERS = ("label", "min_recency_seconds", "tp_pips", "sl_pips", "trade_timeout_seconds")


def run(
    metrics: DataFrame,
    configs: DataFrame,
    *,
    lookback_seconds: int,
    threshold_pips: float,
    pip_size: float,
    warmup_s: float,
    entry_predicates: Sequence[Predicate] = (),
    exit_predicates: Sequence[Predicate] = (),
    empty_exit_closes: bool = False,
) -> DataFrame:
    """(label, pair, parameters, exit_us, pnl_pips, outcome_label) of every configuration's trades, in one plan.

    The configurations are driver-side parameters (tens of rows). Metrics and predicates are computed once; of a tick only
    its time, mid and two flags move, to as many tasks as there are groups of TOGETHER configurations. A task runs the
    machine and the ledger of its group's configurations over its instrument.
    """
    rows = configs.select(*PARAMETERS).collect()
    shared = dict(lookback_seconds=lookback_seconds, threshold_pips=threshold_pips)
    made = [engines.make_params("threshold_reversion", shared | {k: r[k] for k in PARAMETERS[1:]}) for r in rows]
    strategy = simulate.Strategy(name="sweep", entry_name="sweep", engine="stub", params=None, entry_predicates=tuple(entry_predicates), exit_predicates=tuple(exit_predicates), empty_exit_closes=empty_exit_closes)
    groups = -(-len(rows) // TOGETHER)
    ticks = simulate.decided(metrics, strategy).select(*simulate.Reverting.COLUMNS)
    dealt = ticks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = F.concat_ws("\x1f", F.col("part").cast("string"), "instrument")
    width = int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.select(key.alias("instrument"), *simulate.Reverting.COLUMNS[1:]).repartition(width, "instrument").sortWithinPartitions("instrument", "seq")

    def passes(batches):
        books: dict[int, tuple] = {}
        for piece, first, last in runs(batches):
            part, _, pair = piece.column(0)[0].as_py().partition("\x1f")
            if first:
                own = range(int(part) * TOGETHER, min(len(made), (int(part) + 1) * TOGETHER))
                books = {k: (simulate.Reverting(made[k], pip_size, warmup_s), kernels.Ledger(pip_size, "exit", *made[k].multiples())) for k in own}
            for k, (source, ledger) in books.items():
                done = ledger.feed(*source(piece)[1])
                if last:
                    done = done + ledger.finish()
                if done:
                    columns = [pa.array([k] * len(done), pa.int32()), pa.array([pair] * len(done)), *(pa.array([t[c] for t in done], kind) for c, kind in CLOSED)]
                    yield pa.RecordBatch.from_arrays(columns, names=["config", "pair", *(c for c, _ in CLOSED)])

    closed = ordered.mapInArrow(passes, "config int, pair string, signal_seq long, exit_us long, pnl_pips double, outcome_label string")
    named = metrics.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows)], "config int, " + configs.select(*PARAMETERS).schema.simpleString()[7:-1].replace(":", " "))
    return closed.join(F.broadcast(named), "config").drop("config")


CLOSED = (("signal_seq", pa.int64()), ("exit_us", pa.int64()), ("pnl_pips", pa.float64()), ("outcome_label", pa.string()))


def summary(trades: DataFrame) -> DataFrame:
    """Trades and mean result per configuration and pair, in the order of the parameters."""
    keys = ["label", "pair", "min_recency_seconds", "tp_pips", "sl_pips", "trade_timeout_seconds"]
    out = trades.groupBy(*keys).agg(F.count("*").alias("trade_count"), F.avg("pnl_pips").alias("avg_pnl_pips"))
    return out.orderBy("min_recency_seconds", "tp_pips", "trade_timeout_seconds", "pair")
