"""Running moments of an event stream: windows with a watermark, the same aggregates as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, mean, variance; events: ts, event_type, value. Rows later than late are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean", "variance")
