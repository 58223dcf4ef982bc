"""Stored intermediate tables: lineage ends there, so lost executors cost no recomputation of earlier rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a fresh one where that is unset, in local mode only."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_graphloom_tables", None)
    if not base:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = context._graphloom_tables = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[tuple, object] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table has changed: its files' number and bytes, and when the newest was written."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(at)
    files = [status] if status.isFile() else list(fs.listStatus(at))
    return len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def kept(spark: SparkSession, name: str, path: str, make):
    """What make() stored for this table in this application, made anew when the table has changed."""
    key = (spark.sparkContext.applicationId, name, path)
    state = state_of(spark, path)
    if key not in _kept or _kept[key][0] != state:
        _kept[key] = (state, make())
    return _kept[key][1]
