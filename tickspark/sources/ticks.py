"""Tick tables: instrument, seq, ts, ts_us, bid, ask, mid."""

from __future__ import annotations

import calendar
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, TimestampNTZType, TimestampType

from tickspark.errors import FeedError
from tickspark.session import prepare


def months(year_start: int, year_end: int, month_start: int, month_end: int) -> list[tuple[int, int]]:
    """(year, month) from the first to the last, both included."""
    values = (year_start, year_end, month_start, month_end)
    if any(isinstance(v, bool) or not isinstance(v, int) for v in values):
        raise TypeError("years and months must be integers")
    if not (1 <= month_start <= 12 and 1 <= month_end <= 12):
        raise ValueError("months run from 1 to 12")
    first, last = year_start * 12 + month_start - 1, year_end * 12 + month_end - 1
    if first > last:
        raise ValueError("the range ends before it starts")
    return [(m // 12, m % 12 + 1) for m in range(first, last + 1)]


def shard_path(base: str, instrument: str, year: int, month: int) -> str:
    return f"{str(base).rstrip('/')}/{instrument}/{instrument}_{year}-{month:02d}.parquet"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def shard_paths(spark: SparkSession, base: str, instrument: str, wanted: Iterable[tuple[int, int]]) -> list[str]:
    """Paths of an instrument's shards; a missing one is an error of that instrument."""
    paths = [shard_path(base, instrument, y, m) for y, m in wanted]
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FeedError(f"{instrument}: missing shards {missing}")
    return paths


def whole_micros(nanos: Column) -> Column:
    """Microseconds of whole nanoseconds, rounded down, without going through a double."""
    return F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000))


def micros(c: Column, kind) -> Column:
    """Microseconds since the epoch, UTC. Whole numbers are nanoseconds (how nanosecond files are read)."""
    if isinstance(kind, LongType):
        return whole_micros(c)
    if isinstance(kind, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))  # the session zone is UTC
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    return F.unix_micros(c.cast("timestamp"))


def _micros_of(x: datetime | str) -> int:
    moment = datetime.fromisoformat(x) if isinstance(x, str) else x
    since = (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


def between(raw: DataFrame, column: str, start: datetime | str | None, end: datetime | str | None) -> DataFrame:
    """Rows with start <= column <= end (UTC; None: no bound). The bounds are literals of the column's own type, so the scan skips row groups."""
    kind = raw.schema[column].dataType
    for bound, least in ((start, True), (end, False)):
        if bound is None:
            continue
        us = _micros_of(bound)
        if isinstance(kind, LongType):  # nanoseconds
            value = F.lit(us * 1000 + (0 if least else 999))
        else:
            value = F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=us))).cast(kind)
        raw = raw.filter(F.col(column) >= value if least else F.col(column) <= value)
    return raw


def read_shards(spark: SparkSession, paths: list[str], start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Ticks of shards: three columns are read; instrument and month come from the path, order from month and row.

    seq is month << 40 | row: increasing in arrival order without a sort. Quotes become doubles before the mid is taken.
    start and end reach the scan.
    """
    prepare(spark)
    try:
        raw = spark.read.parquet(*paths)
    except Exception as wrong:
        raise FeedError(f"unreadable shards: {wrong}") from wrong
    if missing := {"timestamp", "bid", "ask"} - set(raw.columns):
        raise FeedError(f"shards lack columns {sorted(missing)}")
    kind = raw.schema["timestamp"].dataType
    raw = between(raw, "timestamp", start, end)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_(\d{4})-(\d{2})\.parquet", 1)
    month = F.regexp_extract(F.col("_metadata.file_path"), r"_(\d{4})-(\d{2})\.parquet", 1).cast("long") * 12 + F.regexp_extract(F.col("_metadata.file_path"), r"_(\d{4})-(\d{2})\.parquet", 2).cast("long")
    seq = F.shiftleft(month, 40) + F.col("_metadata.row_index")
    plain = raw.select(name.alias("instrument"), seq.alias("seq"), micros(F.col("timestamp"), kind).alias("ts_us"), F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"))
    return with_mid(plain)


def with_mid(quotes: DataFrame) -> DataFrame:
    """Quotes (instrument, seq, ts_us, bid, ask) with mid and ts."""
    return quotes.select("instrument", "seq", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "bid", "ask", ((F.col("bid") + F.col("ask")) * 0.5).alias("mid"))


def from_events(events: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Ticks from an event table (event_id, ts, event_type, value): types are instruments, the spread follows the id."""
    events = between(events, "ts", start, end)
    us = micros(F.col("ts"), events.schema["ts"].dataType)
    ask = F.col("value") + F.lit(0.01) * (1 + F.col("event_id") % 5)
    return with_mid(events.select(F.col("event_type").alias("instrument"), F.col("event_id").alias("seq"), us.alias("ts_us"), F.col("value").alias("bid"), ask.alias("ask")))


def time_slice(ticks: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Ticks of any table with start <= ts <= end. Readers take the bounds themselves, which lets the scan skip row groups."""
    low, high = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (start, end))
    return ticks.filter(F.col("ts_us").between(low, high))


def shards_between(wanted: list[tuple[int, int]], start: datetime, end: datetime) -> list[tuple[int, int]]:
    """The months that a time range touches: which shards a slice has to open."""
    last_day = lambda y, m: datetime(y, m, calendar.monthrange(y, m)[1], 23, 59, 59, 999999, tzinfo=start.tzinfo)
    return [(y, m) for y, m in wanted if datetime(y, m, 1, tzinfo=start.tzinfo) <= end and last_day(y, m) >= start]


def read_slice(spark: SparkSession, base: str, instrument: str, wanted: Iterable[tuple[int, int]], start: datetime, end: datetime) -> DataFrame:
    """An instrument's ticks with start <= ts <= end: only the months that the range touches are opened, and the bounds reach their scan."""
    touched = shards_between(list(wanted), start, end)
    if not touched:
        raise FeedError(f"{instrument}: no shard between {start} and {end}")
    return read_shards(spark, shard_paths(spark, base, instrument, touched), start, end)
