"""Totals and averages over trailing periods, for every key and day, days without rows included.

Method: block decomposition.  The days of a key are cut into blocks as long as the window.  Inside a
block running sums are taken from the left (prefix) and from the right (suffix).  A window that ends on
day ``i`` covers the end of one block and the start of the next, so its total is one suffix plus one
prefix, whatever the window's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hundredths(value: Column) -> Column:
    """A two-decimal number as exact whole hundredths; null, NaN, infinite and huge values give null."""
    usable = ~F.isnan(value) & (F.abs(value) < 1e15)
    return F.when(usable, F.round(value * 100).cast("long"))


def daily_totals(df: DataFrame, key: str, time: str, value: Column) -> DataFrame:
    """(key, day, rows, total): sums per key and UTC day, combined on the map side.

    Rows without key or time do not count; a null value counts as a row and adds nothing.
    """
    return (
        df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
        .select(F.col(key), F.to_date(time).alias("day"), value.cast("long").alias("_v"))
        .groupBy(key, "day")
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_v"), F.lit(0).cast("long")).alias("total"))
    )


def dense_days(daily: DataFrame, key: str, after: int) -> DataFrame:
    """``daily`` with a zero row for each missing day from the key's first day to ``after`` days past its last, and
    with ``_i``, the number of days since the key's first one.

    A key has at most one row per calendar day here, so the one shuffle by key that all later windows reuse
    is bounded by the calendar, however many rows a hot key had.  Each day brings the empty days up to the
    key's next one, so ``daily`` is read once.  A mistaken day far off makes a row for every day before it.
    """
    by_key = Window.partitionBy(key).orderBy("day")
    apart = F.coalesce(F.datediff(F.lead("day").over(by_key), "day"), F.lit(after + 1))
    since = F.datediff("day", F.first("day").over(by_key))
    spread = daily.repartition(F.col(key)).withColumn("_n", apart).withColumn("_s", since).withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    own = lambda c: F.when(F.col("_d") == 0, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
    return spread.select(key, F.date_add("day", F.col("_d")).alias("day"), own("rows"), own("total"), (F.col("_s") + F.col("_d")).alias("_i"))


def trailing_totals(daily: DataFrame, key: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals over the trailing ``windows`` days for each key and day.

    ``daily`` has (key, day, rows, total) as :func:`daily_totals` makes it.  The result has, for each day
    from the key's first to ``max(windows) - 1`` days past its last (until the longest window is empty
    again), ``rows``, ``total`` and ``total_<w>`` for each window; near the first day a window counts the
    days before it as zero.  An empty input gives an empty result.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows must be positive numbers of days")
    df = dense_days(daily, key, max(windows) - 1)
    for w in windows:
        df = df.withColumn("_b", F.floor(F.col("_i") / w))
        block = Window.partitionBy(key, "_b").orderBy("day")
        prefix = F.sum("total").over(block.rowsBetween(Window.unboundedPreceding, 0))
        suffix = F.sum("total").over(block.rowsBetween(0, Window.unboundedFollowing))
        df = df.withColumn(f"_prefix_{w}", prefix).withColumn(f"_suffix_{w}", suffix)
    by_key = Window.partitionBy(key).orderBy("day")
    for w in windows:
        before = F.coalesce(F.lag(f"_suffix_{w}", w - 1).over(by_key), F.lit(0))
        whole = F.col("_i") % w == w - 1
        df = df.withColumn(f"total_{w}", F.col(f"_prefix_{w}") + F.when(whole, 0).otherwise(before))
    return df.select(key, "day", "rows", "total", *[f"total_{w}" for w in windows])
