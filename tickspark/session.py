"""Spark session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "true",  # shards may hold nanosecond timestamps
}


def session(name: str = "tickspark", **settings: str) -> SparkSession:
    """A session with SETTINGS; further settings by name with dots as double underscores."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    return builder.config(map={k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
