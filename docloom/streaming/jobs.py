"""Job events as a stream: status counts in event-time windows, each event counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statuses(events: DataFrame, watermark: str = "1 day", window: str = "1 day") -> DataFrame:
    """Events of each type and window; late ones beyond the watermark and repeated ids are left out.
    Works on streams and tables alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", watermark)
    e = e.dropDuplicates(["event_id", "ts"])
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
