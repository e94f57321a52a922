"""Ticks as a stream: validation and the reversion machine with state per instrument, the ledger per finished batch.

Late ticks are those that the batch engine calls regressions: they are dropped by the same rule, against the latest
accepted time of their instrument, which is part of the state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickspark.operators import kernels
from tickspark.operators.engines import ThresholdReversionParams
from tickspark.operators.validate import quote_issue

OUTPUT = "instrument string, seq long, ts_us long, mid double, position double, reference_price double, edge boolean, regression boolean"


def tick_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of tick tables (instrument, seq, ts_us, bid, ask)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sound(quotes: DataFrame) -> DataFrame:
    """Quotes with their mid that have nothing wrong on their own: stateless, so it works on streams and tables alike."""
    with_mid = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) * 0.5)
    return with_mid.withColumn("__issue", quote_issue()).filter("__issue IS NULL").drop("__issue")


def reversion_stream(quotes: DataFrame, params: ThresholdReversionParams, pip_size: float) -> DataFrame:
    """Every sound tick with the machine's position; state per instrument is the machine and the last accepted time.

    Within a trigger ticks are taken in order of seq. State is bounded by the lookback.
    """

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.exists:
            machine, latest, before = pickle.loads(state.get[0])
        else:
            levels = (params.lookback_seconds, params.threshold_pips, params.tp_pips, params.sl_pips)
            machine, latest, before = kernels.Reversion(*levels, pip_size, params.min_recency_seconds, params.trade_timeout_seconds), None, 0.0
        ticks = pd.concat(list(frames)).sort_values("seq", kind="stable")
        ts, mid = ticks.ts_us.to_numpy(np.int64), ticks.mid.to_numpy(float)
        seen = np.maximum.accumulate(np.concatenate(([ts[0] if latest is None else latest], ts)))
        late = ts < seen[:-1]
        values = machine.run(ts[~late], mid[~late])
        position = values["position"]
        taken = (position != 0) & (position != np.concatenate(([before], position[:-1])))
        out = pd.DataFrame({"instrument": key[0], "seq": ticks.seq.to_numpy(), "ts_us": ts, "mid": mid, "position": np.nan, "reference_price": np.nan, "opens": False, "late": late})
        out.loc[~late, "position"], out.loc[~late, "reference_price"], out.loc[~late, "opens"] = position, values["reference_price"], taken
        latest, before = int(seen[-1]), float(position[-1]) if len(position) else before
        state.update((pickle.dumps((machine, latest, before)),))
        out.columns = [x.split()[0] for x in OUTPUT.split(", ")]
        yield out

    return sound(quotes).groupBy("instrument").applyInPandasWithState(step, OUTPUT, "state binary", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(quotes: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """Ticks and mean spread per instrument and window; ticks later than `late` are dropped by the watermark."""
    timed = sound(quotes).withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
    counted = timed.groupBy("instrument", F.window("ts", window, slide)).agg(F.count("*").alias("ticks"), F.avg(F.col("ask") - F.col("bid")).alias("avg_spread"))
    return counted.select("instrument", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "ticks", "avg_spread")
