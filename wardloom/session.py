"""Session settings and the shared folder that lineage is cut to."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are written for.  They are runtime settings only; the cluster's own memory,
#: core and partition settings are left alone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "wardloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where none is set and driver and executors are one process (tests) a temporary folder is chosen; a
    cluster without the setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not is_local(sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="wardloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process: ``local``, ``local[n]``, but not ``local-cluster``."""
    return master == "local" or master.startswith("local[")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read back, so that its lineage ends there.

    Later stages read columns of it again instead of computing it again, also when an executor is lost.
    The table is deleted by :func:`drop`, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wardloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wardloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table of a :func:`cut` that no later stage reads."""
    path = getattr(df, "_wardloom_path", None)
    if path:
        _forget(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is the cluster's own temporary one
        pass
