"""Running totals of a stream of records: windowed, late rows by watermark, state kept by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of rows (ts, event_type, value), for batches and streams alike."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def running_barcode_totals(records: DataFrame) -> DataFrame:
    """Totals of each barcode so far; for update or complete output."""
    return records.groupBy("bc_id").agg(F.sum("value").alias("total"), F.count("*").alias("n_features"))
