"""Readers of the driver's tables, and the clean forms every operator starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``; times without zone become UTC timestamps."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    casts = {c: F.col(f"`{c}`").cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all of the cluster's slots where its parts are fewer (CPU-bound work follows).

    A table of many parts is read where it lies, without a shuffle.  Only their number reaches the driver.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def canonical_uuid(value: Column) -> Column:
    """Lower-case uuid with hyphens from any usual spelling (case, braces, ``urn:uuid:``, no hyphens, blanks).

    Text without exactly 32 hexadecimal digits gives null.
    """
    digits = F.regexp_replace(F.regexp_replace(F.lower(value), r"^\s*urn:uuid:", ""), r"[{}()\-\s]", "")
    parts = [F.substring(digits, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def one_per_key(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per ``key``: the first by ``order`` (nulls first, ties by the kept values).

    Re-deliveries have the same content, so the choice only matters for damaged input; it is
    deterministic all the same.  The aggregate combines on the map side before its one shuffle.
    """
    rest = [c for c in keep if c not in order]
    least = F.min(F.struct(*[F.col(c) for c in [*order, *rest]])).alias("_row")
    return df.groupBy(key).agg(least).select(key, *[F.col(f"_row.{c}").alias(c) for c in keep])


def audit_ledger(spark: SparkSession, folder: str, keep: list[str]) -> DataFrame:
    """audit_ledger with one row per id (the first delivery) and ``keep`` besides id."""
    raw = table(spark, folder, "audit_ledger")
    needed = list(dict.fromkeys(["id", "received_at", *keep]))
    return one_per_key(raw.select(*needed), "id", ["received_at"], keep)


def audit_events(spark: SparkSession, folder: str, keep: list[str]) -> DataFrame:
    """audit_events with one row per event_id and ``keep`` besides event_id."""
    raw = table(spark, folder, "audit_events")
    return one_per_key(raw.select("event_id", *keep), "event_id", [], keep)
