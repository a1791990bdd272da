"""The streaming forms of session deduplication and cache telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unseen_keys(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen yet, with state bounded by the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def telemetry(stream: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Hits and misses in tumbling windows of event time."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, window), "operation")
    return w.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("hit"), 1)).alias("hits")).select(F.col("window.start").alias("start"), "operation", "total", "hits")


def parquet_stream(spark, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
