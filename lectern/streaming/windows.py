"""Windowed counts over an event stream (an extension: the batch engine has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, event_type, n) for a streaming or batch frame of ts and event_type; late rows drop after ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if timed.isStreaming else timed
    counted = marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("starts"), "event_type", "n")
