"""Streaming extensions over an event log: windows with watermarks, and incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per window; in a stream, rows later than ``late`` are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "6 hours", slide: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a pause of ``gap``."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def latest_by_user(events: DataFrame) -> DataFrame:
    """(user_id, last_ts, n): when a user was last seen, how often."""
    return events.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def ingest_stream(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts ingestion of a stream of files; ``apply`` gets each batch and its number, once."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
