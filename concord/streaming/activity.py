"""Live activity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(activity: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Counts per time window and action: the same aggregate serves a batch table and a stream."""
    counted = activity.groupBy(F.window("at", width).alias("w"), "action").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "action", "n")


def session_counts(activity: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Events of a key that follow each other within `gap`, counted per session; for a table and for a stream with a watermark."""
    counted = activity.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("session_start"), "n")


def live_counts(activity: DataFrame, width: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """The streaming form: repeated events (same id) are dropped and late ones accepted up to the watermark, so the
    state holds only the ids and windows of the last `lateness`."""
    fresh = activity.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["id"])
    return window_counts(fresh, width)
