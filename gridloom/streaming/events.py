"""Running summaries of an event stream (an addition of this library's own)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_line_fit(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """For each window and event type the count and the least-squares line of value over seconds within the window.

    Works on a batch or a stream; a stream's state is dropped once ``late`` has passed.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    base = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width)
    x = F.unix_micros("ts") / 1e6
    keyed = base.withColumn("w", w).withColumn("x", x - F.unix_micros(F.col("w.start")) / 1e6)
    return keyed.groupBy("w", "event_type").agg(F.count("*").alias("n"), F.regr_intercept("value", "x").alias("b0"), F.regr_slope("value", "x").alias("b1")).select(F.col("w.start").alias("start"), "event_type", "n", "b0", "b1")
