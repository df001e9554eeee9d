"""Queries of the general problems 1, 2 and 5, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.operators import nested, rolling, sessions
from wardloom.sources.tables import audit_ledger, canonical_uuid, one_per_key, table

#: Fixed values of the data: fields that hold a list even where a lone object stands.
LIST_FIELDS = frozenset("guards findings related spans tools_available scopes handoffs hops calls args batches".split())
SHAPE = nested.Shape(LIST_FIELDS)


# ---- problem 1


def metadata_records(spark: SparkSession, folder: str, once: bool = True) -> DataFrame:
    """origin, record_key and metadata of both audit tables, blank metadata left out; one row per key."""
    parts = []
    for name, key in (("audit_ledger", "id"), ("audit_events", "event_id")):
        raw = table(spark, folder, name).select(F.col(key).cast("string").alias("record_key"), "metadata")
        raw = raw.where(F.trim("metadata") != "")
        if once:
            raw = one_per_key(raw, "record_key", [], ["metadata"])
        parts.append(raw.select(F.lit(name).alias("origin"), "record_key", "metadata"))
    return parts[0].unionByName(parts[1])


def metadata_plan(spark: SparkSession, folder: str) -> nested.Plan:
    return nested.analyse(metadata_records(spark, folder, once=False), SHAPE)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every object that stands in a list at any depth: rows of the flat tables of repeated elements."""
    return p1_tables(spark, folder).where("in_list and is_object").select("origin", "record_key", "node_path")


def p1_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Every flat table with its number of rows, of rows without a key of their own, and of rows whose parent is missing."""
    return nested.check_keys(p1_tables(spark, folder))


def p1_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of every flat table, with the number of rows that have a value there."""
    return nested.table_columns(p1_tables(spark, folder))


def p1_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of all flat tables in one frame, keys and inlined values."""
    return nested.shred(metadata_records(spark, folder), metadata_plan(spark, folder), SHAPE)


def p1_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of one repeated and recursive element."""
    plan = metadata_plan(spark, folder)
    return nested.flat_table(nested.shred(metadata_records(spark, folder), plan, SHAPE), plan, "findings")


# ---- problem 2


def ledger_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sums of risk_score in hundredths per actor."""
    rows = audit_ledger(spark, folder, ["actor_id", "risk_score", "occurred_at"])
    rows = rows.select(canonical_uuid(F.col("actor_id")).alias("actor_id"), "occurred_at", "risk_score")
    return rolling.daily_totals(rows, "actor_id", "occurred_at", rolling.hundredths(F.col("risk_score")))


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and averages per day over the last 7 and 30 days, for every actor and day."""
    df = rolling.trailing_totals(ledger_days(spark, folder), "actor_id", (7, 30))
    columns = [F.col("actor_id"), F.date_format("day", "yyyy-MM-dd").alias("activity_day"), F.col("rows").alias("n_rows")]
    for w in (7, 30):
        columns += [(F.col(f"total_{w}") / 100).alias(f"total_{w}d"), (F.col(f"total_{w}") / (100 * w)).alias(f"average_{w}d")]
    return df.select(*columns)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Actor days whose 7-day total is at least 1.50 and whose 7-day average is over twice the 30-day one."""
    df = rolling.trailing_totals(ledger_days(spark, folder), "actor_id", (7, 30))
    hot = (F.col("total_7") >= 150) & (F.col("total_7") * 30 > F.col("total_30") * 14)
    return df.where(hot).select("actor_id", F.date_format("day", "yyyy-MM-dd").alias("activity_day"))


# ---- problem 5


def ledger_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = audit_ledger(spark, folder, ["actor_id", "occurred_at"])
    rows = rows.select(canonical_uuid(F.col("actor_id")).alias("actor_id"), "occurred_at")
    return sessions.sessions(rows, ["actor_id"], "occurred_at", 1800)


def p5_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Every session with start, end, duration and number of rows."""
    return ledger_sessions(spark, folder).select("actor_id", "start_us", "end_us", "duration_us", "events")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of at least 3 rows."""
    return ledger_sessions(spark, folder).where("events >= 3").select("actor_id", "start_us", "end_us")


_LEDGER = r"""
ledger as (
  select id,
    case when length(hex) = 32 then concat_ws('-', substr(hex, 1, 8), substr(hex, 9, 4), substr(hex, 13, 4),
      substr(hex, 17, 4), substr(hex, 21, 12)) end as actor_id, risk_score, occurred_at
  from (select id, regexp_replace(lower(any_value(actor_id)), '[{}()\s-]', '', 'g') as hex,
      any_value(risk_score) as risk_score, any_value(occurred_at) as occurred_at from audit_ledger group by id))"""

_ROLLING = rf"""
with {_LEDGER},
daily as (
  select actor_id, cast(occurred_at as date) as day, count(*) as n_rows,
    coalesce(sum(case when not isnan(risk_score) then cast(round(risk_score * 100) as bigint) end), 0) as total
  from ledger where actor_id is not null and occurred_at is not null group by 1, 2),
days as (
  select actor_id, cast(unnest(generate_series(min(day), max(day) + 29, interval 1 day)) as date) as day
  from daily group by actor_id),
dense as (
  select actor_id, day, coalesce(n_rows, 0) as n_rows, coalesce(total, 0) as total
  from days left join daily using (actor_id, day)),
windowed as (
  select actor_id, day, n_rows,
    cast(sum(total) over (partition by actor_id order by day rows 6 preceding) as bigint) as t7,
    cast(sum(total) over (partition by actor_id order by day rows 29 preceding) as bigint) as t30 from dense)"""

_SESSIONS = rf"""
with {_LEDGER},
timed as (select actor_id, epoch_us(occurred_at) as us from ledger where actor_id is not null and occurred_at is not null),
opened as (
  select *, case when us - lag(us) over (partition by actor_id order by us) <= 1800000000 then 0 else 1 end as opens from timed),
numbered as (
  select *, sum(opens) over (partition by actor_id order by us rows unbounded preceding) as s from opened),
merged as (
  select actor_id, min(us) as start_us, max(us) as end_us, max(us) - min(us) as duration_us, count(*) as events
  from numbered group by actor_id, s)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_tables": p1_tables,
    "p1_findings": p1_findings,
    "p1_keys": p1_keys,
    "p1_columns": p1_columns,
    "p2_found": p2_found,
    "p2_rolling": p2_rolling,
    "p5_found": p5_found,
    "p5_sessions": p5_sessions,
}

SQL = {
    "p2_found": _ROLLING
    + """
select actor_id, strftime(day, '%Y-%m-%d') as activity_day from windowed where t7 >= 150 and t7 * 30 > t30 * 14""",
    "p2_rolling": _ROLLING
    + """
select actor_id, strftime(day, '%Y-%m-%d') as activity_day, n_rows, t7 / 100 as total_7d, t7 / 700 as average_7d,
  t30 / 100 as total_30d, t30 / 3000 as average_30d from windowed""",
    "p5_found": _SESSIONS + "\nselect actor_id, start_us, end_us from merged where events >= 3",
    "p5_sessions": _SESSIONS + "\nselect actor_id, start_us, end_us, duration_us, events from merged",
}
