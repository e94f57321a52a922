"""Trade ledgers: reading, discovery, picks."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.files import Files
from tickspark.sources.ticks import whole_micros

REQUIRED = ("entry_time", "exit_time", "pnl_pips")
#: Folders of a run that are not pairs.
NOT_PAIRS = ("logs", "analysis")


def load_trades(spark: SparkSession, path: str) -> DataFrame:
    """A ledger in order of exit; a missing file, a missing column or an empty table is an error. Times that do not parse are null."""
    if not Files(spark).exists(str(path)):
        raise FileNotFoundError(f"Trades file not found: {path}")
    df = spark.read.parquet(str(path))
    if missing := sorted(set(REQUIRED) - set(df.columns)):
        raise ValueError(f"Trades file missing required columns: {missing}")
    if df.isEmpty():
        raise ValueError(f"Trades file {path} contains no rows")
    kinds = dict(df.dtypes)
    stamp = lambda c: F.timestamp_micros(whole_micros(F.col(c))) if kinds[c] == "bigint" else F.expr(f"try_cast(`{c}` AS TIMESTAMP)")
    return df.withColumns({c: stamp(c) for c in REQUIRED[:2]}).orderBy("exit_time")


def discover(spark: SparkSession, root: str | Path) -> DataFrame:
    """All ledgers below a run's output folder as one table, pair from the folder name where the rows lack it."""
    found = discover_paths(spark, root)
    if not found:
        raise FileNotFoundError(f"no trades below {root}")
    df = spark.read.option("mergeSchema", "true").parquet(*found.values())
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/trades\.parquet", 1)
    return df.withColumn("pair", F.coalesce("pair", folder) if "pair" in df.columns else folder)


def discover_paths(spark: SparkSession, root: str | Path) -> dict[str, str]:
    """pair -> ledger below a run's output folder, in any file system that Spark reads."""
    files, base = Files(spark), str(root).rstrip("/")
    names = [x for x in files.listed(base) if x not in NOT_PAIRS] if files.exists(base) else []
    return {x: f"{base}/{x}/trades.parquet" for x in names if files.exists(f"{base}/{x}/trades.parquet")}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A sweep's manifest.csv."""
    return spark.read.csv(str(path), header=True, inferSchema=False).withColumns({c: F.col(c).cast("double") for c in ("min_recency_seconds", "tp_pips", "sl_pips", "trade_timeout_seconds")})


def pick(trades: DataFrame, index: int | None = None, seed: int | None = None) -> DataFrame:
    """One trade by its place in the order of exits, or a random one (seeded on the driver)."""
    n = trades.count()
    if not n:
        raise ValueError("no trades to pick from")
    if index is None:
        index = random.Random(seed).randrange(n)
    if not -n <= index < n:
        raise IndexError(f"trade {index} of {n}")
    return trades.orderBy("exit_time").offset(index % n).limit(1)


def around(ticks: DataFrame, trade: DataFrame, least_padding_s: float = 60.0) -> DataFrame:
    """Ticks of one trade's time, padded on both sides by the longer of its duration and least_padding_s."""
    row = trade.select((F.unix_micros("entry_time")).alias("a"), (F.unix_micros("exit_time")).alias("b"), *(["pair"] if "pair" in trade.columns else [])).first()
    pad = max(row.b - row.a, int(least_padding_s * 1e6))
    inside = ticks.filter(F.col("ts_us").between(row.a - pad, row.b + pad))
    return inside.filter(F.col("instrument") == row.pair) if "pair" in row else inside
