"""Shared plumbing of the corpus operators: inputs, the shared folder, batches of text."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as one batch.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh local one only in local mode, where that is unset."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_graphloom_dir", None)
    if not base:
        if not conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext._graphloom_dir = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and executors may be lost afterwards."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def release(spark: SparkSession, *settled: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, and let Spark's cleaner see that shuffles before them are done with."""
    jvm = spark.sparkContext._jvm
    for df in settled:
        path = jvm.org.apache.hadoop.fs.Path(df._settled)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.range(1).count()  # the scheduler holds on to the last job that ran
    jvm.System.gc()


#: A group of more than one row in HOT_SHARE is dealt to SALTS tasks; fewer than HOT_SHARE groups can be that large.
HOT_SHARE, SALTS = 2000, 32


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, by: str, least: int = 2000) -> DataFrame:
    """rows joined (inner) with groups, which has one row per key and, in column size, how many rows the key has.

    The rows of a large group go to SALTS tasks, by the hash of column `by`, and the group's row to each of them. Which
    keys are large is told to all tasks by 64-bit hashes, fewer than HOT_SHARE; a hash that two keys share only salts both.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(least, total // HOT_SHARE)
    hot = [r["h"] for r in groups.filter(F.col(size) > limit).select(F.xxhash64(key).alias("h")).collect()]
    if not hot:
        return rows.join(groups, key)
    is_hot = F.xxhash64(key).isin(hot)
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int"))
    dealt = groups.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(dealt, [key, "_salt"]).drop("_salt")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def buckets_for(df: DataFrame, text_col: str, bytes_each: int, least: int = 12) -> int:
    """How many groups of about bytes_each bytes of text the rows make; grows with the input."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(least, -(-total // bytes_each))


_held: list[tuple[object, object]] = []


def held(key: object, make):
    """What make() gives, kept in this Python worker until another thing is wanted; one thing at a time."""
    if not _held or _held[0][0] != key:
        _held.clear()
        _held.append((key, make()))
    return _held[0][1]


def _tidy() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(f):
    """Give memory back when the function, or the generator, has ended: workers live on idle."""

    @functools.wraps(f)
    def plain(*args):
        try:
            return f(*args)
        finally:
            _tidy()

    @functools.wraps(f)
    def generator(*args):
        try:
            yield from f(*args)
        finally:
            _tidy()

    return generator if inspect.isgeneratorfunction(f) else plain


def text_batches(batches: Iterator[pa.RecordBatch], col: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about limit bytes of text (one row at least)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(col)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
