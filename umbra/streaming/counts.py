"""Incremental counts over a stream of rows (an extension: event-time windows with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(rows: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n) for streams and tables alike; rows later than the watermark are dropped by a stream."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
