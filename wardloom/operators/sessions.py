"""Sessions: the activity of a key between gaps of inactivity.

Method: merging interval state.  Every event opens the interval [t, t + gap]; intervals of a key that
overlap merge into one session with its first and last time and its number of events.  Merging is
associative and commutative, so it is done in two steps: first events that share a slot of at most one
gap's length (they are always in one session) merge by a plain hash aggregate that combines on the map
side, then the few slot intervals of each key merge in time order.  A hot key thus reaches the second
step with at most (span / gap) rows, however many events it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slot_intervals(df: DataFrame, keys: list[str], time: str, gap_us: int) -> DataFrame:
    """(keys, start_us, end_us, events): the events of each gap-length slot merged to one interval."""
    us = F.unix_micros(F.col(time))
    usable = F.col(time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    return (
        df.where(usable)
        .select(*keys, us.alias("_us"))
        .groupBy(*keys, (F.col("_us") - F.pmod("_us", F.lit(gap_us + 1))).alias("_slot"))
        .agg(F.min("_us").alias("start_us"), F.max("_us").alias("end_us"), F.count(F.lit(1)).alias("events"))
        .drop("_slot")
    )


def merge_intervals(intervals: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Merge (keys, start_us, end_us, events) intervals that lie at most ``gap_us`` apart.

    Also merges the closed sessions of a stream with late ones: its input may be its own output.
    """
    order = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_us").over(earlier)
    opens = F.when(reach.isNull() | (F.col("start_us") - reach > gap_us), 1).otherwise(0)
    numbered = intervals.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(order))
    return (
        numbered.groupBy(*keys, "_session")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("events").alias("events"))
        .withColumn("duration_us", F.col("end_us") - F.col("start_us"))
        .drop("_session")
    )


def sessions(df: DataFrame, keys: list[str], time: str, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of ``keys`` by ``time``: keys, start_us, end_us, events, duration_us.

    A session ends where the next event is more than ``gap_seconds`` later; an event exactly the gap
    later still belongs to it.  Rows with a null key or time belong to none.  Equal times are one
    instant with several events.  An empty input gives an empty result.
    """
    if gap_seconds < 0:
        raise ValueError("gap_seconds must not be negative")
    gap_us = gap_seconds * 1_000_000
    return merge_intervals(slot_intervals(df, keys, time, gap_us), keys, gap_us)
