"""Sessions over a stream: the same merging interval state, kept per key under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, key: str, time: str, gap_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """Closed sessions of a streaming DataFrame; columns as in the batch operator, ``key`` included.

    Spark keeps an interval [t, t + gap) for every event and merges overlapping ones of a key; the gap
    is one microsecond longer so that an event exactly ``gap_seconds`` later still joins.  Events later
    than the watermark ``late`` are dropped by the engine and counted in its metrics; those within it
    still merge two sessions into one.  Rows with a null key or time are left out.
    """
    gap = f"{gap_seconds * 1_000_000 + 1} microseconds"
    usable = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    merged = (
        usable.withWatermark(time, late)
        .groupBy(F.col(key), F.session_window(F.col(time), gap))
        .agg(F.min(F.unix_micros(time)).alias("start_us"), F.max(F.unix_micros(time)).alias("end_us"), F.count(F.lit(1)).alias("events"))
    )
    return merged.select(key, "start_us", "end_us", "events", (F.col("end_us") - F.col("start_us")).alias("duration_us"))
