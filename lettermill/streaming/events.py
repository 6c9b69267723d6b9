"""Windows over event time: tumbling counts, sessions, duplicates; on streams and on tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as an instant (UTC), which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def daily_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """``day, event_type, n, total``; with ``late``, a stream's days close that long after their end."""
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if late else rows
    counts = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """``user_id, start, end, n``: events of a user with less than ``gap`` between them."""
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if late else rows
    found = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str | None = None) -> DataFrame:
    """Each event_id once; on a stream within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if late else events.dropDuplicates(["event_id"])
