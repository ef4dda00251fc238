"""Streaming twins: monthly counters and deduplication on arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per user and calendar month; state of a month ends with the watermark."""
    month = F.date_trunc("month", "ts").alias("month")
    return events.withWatermark("ts", late).groupBy("user_id", month).agg(F.count("*").alias("n"))


def first_arrivals(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows whose checksum hasn't arrived within the watermark: streaming dedup by content."""
    return docs.withColumn("checksum", F.sha2(F.col("text"), 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["checksum"])
