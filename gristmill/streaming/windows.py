"""Event-time windows, sessions and duplicates, for streams and for tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a time with a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def _late(events: DataFrame, ts: str, lateness: str) -> DataFrame:
    return events.withWatermark(ts, lateness) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, keys: list[str], value: str, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    return sliding(events, size, size, keys, value, ts, lateness)


def sliding(events: DataFrame, size: str, slide: str, keys: list[str], value: str, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    grouped = _late(timed(events, ts), ts, lateness).groupBy(F.window(ts, size, slide), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    grouped = _late(timed(events, ts), ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """One event a key; a stream forgets keys after the lateness."""
    events = timed(events, ts)
    if events.isStreaming:
        return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
