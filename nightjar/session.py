"""Session helpers: one place for the settings every operator relies on.

Operators never create a session; they take DataFrames. These helpers are for
entry points, tests and the bench.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DateType, MapType, NumericType, StringType, StructType,
                               TimestampNTZType, TimestampType)

# Settings the library's semantics depend on (UTC wall clock for TIMESTAMP_NTZ
# conversions, ANSI errors surfaced as try_* functions) plus AQE for runtime
# re-planning of joins, partition coalescing and skew splitting.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "nightjar", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(REQUIRED_CONF)
    conf.update({
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("NIGHTJAR_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # independent fits run side by side (operators/parallel.py)
        "spark.scheduler.mode": "FAIR",
        # Plans here are built from hundreds of Column calls; capturing the
        # Python call site for every one of them (error context only) costs
        # seconds of driver time per query.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    })
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the semantic settings to an existing session (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave as is
            pass
    return spark


_SET: set[tuple[str, str]] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    On a cluster this is ``spark.checkpoint.dir`` as set by the operator of the
    cluster. Where it is unset, a folder under the home folder of Hadoop's
    default file system is taken and deleted when the session ends; a cluster
    whose default file system is local to each machine has no shared folder,
    which is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if (sc.applicationId, configured) not in _SET:  # each setting makes a folder
            sc.setCheckpointDir(configured)
            _SET.add((sc.applicationId, configured))
        return configured
    fs = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
    if fs.getScheme() == "file" and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    path = sc._jvm.org.apache.hadoop.fs.Path(fs.getHomeDirectory(), f".nightjar/{uuid.uuid4().hex}")
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    spark.conf.set("spark.checkpoint.dir", path.toString())
    sc.setCheckpointDir(path.toString())
    _SET.add((sc.applicationId, path.toString()))
    return path.toString()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a run's folder once what was made from it is consumed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df):
    """Rows written once to the shared checkpoint folder (never local) and read
    back. Parquet, so that each pass reads only its columns; what it cannot hold
    (void types, repeated names, types of user code) goes into a checkpoint."""
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if not _storable(df.schema):
        return df.checkpoint(eager=True)
    path = f"{base.rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _storable(schema) -> bool:
    def plain(t):
        if isinstance(t, ArrayType):
            return plain(t.elementType)
        if isinstance(t, MapType):
            return plain(t.keyType) and plain(t.valueType)
        if isinstance(t, StructType):
            names = [f.name.lower() for f in t.fields]
            return bool(names) and len(set(names)) == len(names) and all(plain(f.dataType) for f in t.fields)
        return isinstance(t, _PLAIN)
    return plain(schema)


_PLAIN = (NumericType, StringType, BinaryType, BooleanType, DateType, TimestampType, TimestampNTZType)
