"""Extension: event streams cut into segments by pauses, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pause_segments(events: DataFrame, key: str = "user_id", time: str = "ts", pause: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Segments of a key without a pause: start, end, n; the same plan for batch and streaming tables."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(key, F.session_window(time, pause).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
