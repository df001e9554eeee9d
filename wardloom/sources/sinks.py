"""Sinks and small sources: audit log, alerts, write-once ledger, vector manifests, semantic cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

MANIFEST = Y.StructType([Y.StructField("vectors", Y.ArrayType(Y.StructType([Y.StructField(n, k) for n, k in (("id", Y.StringType()), ("name", Y.StringType()), ("tier", Y.StringType()), ("action", Y.StringType()))])))])


def append_audit(df: DataFrame, folder: str) -> None:
    """Appends events to the audit table, partitioned by day so that readers prune."""
    df.withColumn("log_day", F.to_date("logged_at")).write.mode("append").partitionBy("log_day").parquet(folder)


def alerts(df: DataFrame, least: int = 4) -> DataFrame:
    """Events of high severity that name an agent."""
    return df.where((F.col("severity") >= least) & F.col("agent_id").isNotNull())


def rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the table's rules, the others): severity 1 to 5, a risk code, a time."""
    good = F.coalesce(F.col("severity").between(1, 5), F.lit(False)) & F.col("risk_code").isNotNull() & F.col("logged_at").isNotNull()
    return df.where(good), df.where(~good)


def audit_stream(events: DataFrame, folder: str, alert_folder: str, checkpoint: str):
    """A streaming query that appends each batch to the audit table and its alerts to another."""

    def batch(df: DataFrame, _: int) -> None:
        append_audit(df, folder)
        alerts(df).write.mode("append").parquet(alert_folder)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_entries(df: DataFrame, payload: str, time: str) -> DataFrame:
    """``df`` with ``entry_hash``: SHA-256 of payload and time, for a table that is only appended to."""
    return df.withColumn("entry_hash", F.sha2(F.concat_ws("|", F.col(payload), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")), 256))


def last_entry(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, value) of each key's latest row; ties by the greater value."""
    return df.groupBy(key).agg(F.max(F.struct(F.col(time), F.col(value))).alias("m")).select(key, F.col(f"m.{value}").alias(value))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, tier, action) of a JSON manifest, with a fixed schema; a missing file is an error."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.explode("vectors").alias("v")).select("v.*")


def cache_get(df: DataFrame, prompt: str, cache: DataFrame) -> DataFrame:
    """``df`` with ``cached``: the response stored under the prompt's hash (cache: prompt_hash, response)."""
    keyed = df.withColumn("_h", F.sha2(F.col(prompt), 256))
    return keyed.join(cache.select(F.col("prompt_hash").alias("_h"), F.col("response").alias("cached")), "_h", "left").drop("_h")


def live(df: DataFrame, expires: str, as_of) -> DataFrame:
    """Rows of a keyed table whose time to live has not ended at ``as_of``."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > as_of))


def tenant_scope(df: DataFrame, column: str, tenant: str) -> DataFrame:
    """Rows of one tenant; the value is a literal of the plan and never becomes SQL text."""
    return df.where(F.col(column) == F.lit(tenant))
