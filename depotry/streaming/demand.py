"""Demand from a stream of events: windowed counts by point, late events within the watermark included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def demand_by_window(events: DataFrame, key: str, time: str = "ts", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window_start, key, orders) of a stream or a table of order events."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    return held.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("orders")).select(F.col("w.start").alias("window_start"), key, "orders")


def keep_latest(target: str):  # noqa: ANN201
    """foreachBatch writer: each batch's changed counts replace the batch folder of the same id, so a retry changes nothing.

    A window comes again with each batch that adds to it; ``latest`` reads the last of its counts.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """(window_start, key, orders) as of the last batch in ``target``: one row a window and key."""
    return spark.read.parquet(target).groupBy("window_start", key).agg(F.max_by("orders", "batch").alias("orders"))
