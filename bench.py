"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tickspark.operators import simulate, validate
    from tickspark.operators.metrics import add_metrics, make_metric
    from tickspark.plans import queries as q

    hours = 3600
    default = [
        make_metric("z30m", "zscore", {"lookback_seconds": 6 * hours}), make_metric("z5m", "zscore", {"lookback_seconds": hours}), make_metric("vol_5m", "ewma_vol", {"tau_seconds": hours, "percentile_horizon_seconds": hours, "base_vol": 0.5}),
        make_metric("vol_30m", "ewma_vol", {"tau_seconds": 6 * hours, "percentile_horizon_seconds": 6 * hours, "base_vol": 0.5}), make_metric("session", "session"), make_metric("drift", "drift_sign", {"lookback_seconds": 6 * hours}),
        make_metric("ewma", "ewma", {"tau_seconds": hours}), make_metric("slope", "ewma_slope", {"tau_seconds": hours, "window_seconds": hours}), make_metric("spread", "spread", {"pip_size": 0.01, "window_seconds": hours}), make_metric("rate", "tick_rate", {"window_seconds": 3 * hours}),
    ]

    def scan(s, d):
        return validate.tally(validate.audit(q.ticks(s, d)))

    def metrics(s, d):
        return add_metrics(q.accepted(s, d), default)

    def pipeline(s, d):
        return simulate.run_strategy(metrics(s, d), q.REVERSION, 1.0, 86_400.0)

    def many(s, d):
        """The full pipeline over 20 copies of the ticks under instruments of their own: work enough to hide start-up."""
        from pyspark.sql import functions as F

        copies = q.accepted(s, d).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
        ticks = copies.withColumn("instrument", F.concat("instrument", F.lit("-"), F.col("copy").cast("string"))).drop("copy")
        return simulate.run_strategy(add_metrics(ticks, default), q.REVERSION, 1.0, 86_400.0)

    def single(s, d):
        """The full pipeline over one instrument: 20 copies of all ticks one after another, 2 million at sf0.1."""
        from pyspark.sql import functions as F

        month = 30 * 86_400_000_000
        copies = q.ticks(s, d).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(19))))
        us = F.col("ts_us") + F.col("copy") * month
        one = copies.select(F.lit("ONE").alias("instrument"), (F.shiftleft(F.col("copy").cast("long"), 32) + F.col("seq")).alias("seq"), F.timestamp_micros(us).alias("ts"), us.alias("ts_us"), "bid", "ask", "mid")
        return simulate.run_strategy(add_metrics(validate.accepted(validate.audit(one)), default), q.REVERSION, 1.0, 86_400.0)

    headline = {"scan_validate": scan, "ten_metrics": metrics, "full_pipeline": pipeline, "full_pipeline_x20": many, "one_instrument_x20": single}
    headline |= {n: q.queries()[n] for n in ("flagship_session_spread", "trades_crossover", "performance", "stratify")}
    took = {}
    for name, query in headline.items():
        times = []
        for _ in range(4):  # the first warms up
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    ticks = q.ticks(spark, sf_dir).count()
    told = {"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "ticks": ticks}
    for rate, query, copies in (("full_pipeline", "full_pipeline", 1), ("x20", "full_pipeline_x20", 20), ("one_instrument", "one_instrument_x20", 20)):
        told[f"ticks_per_sec_{rate}"] = round(copies * ticks / took[query])
    print(json.dumps(told | {"cpus": int(cpus)}))


if __name__ == "__main__":
    main()
