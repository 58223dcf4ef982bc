"""Token ids on disk, coded by an adaptive context-mixing range coder in independent, checksummed blocks.

The coder (IdMixer.java) mixes order-0 to order-2 predictions of each id and drives binary and multi-symbol range coding
with them; a coder is a loop over ids with tables that change at each, which neither DataFrame functions nor NumPy
express well, so it is a user-defined function in the JVM, compiled from its source by the compiler that comes with
Spark and shipped to executors as a jar.

File: a folder of Parquet files, each part in ascending doc_id order and the parts in ascending order too. A row is a
stripe of whole documents, about 65,536 ids: part, nth (its place in the part), before and n (ids of the part before it,
and its own), doc_ids, offsets (ids of the stripe before each document) and data: a table of blocks of about 65,536
ids with their lengths and crc32, and the blocks. A block starts from nothing and can be decoded alone; one that
differs from its checksum raises. Documents longer than a block lie in several blocks of one stripe.

Defined cases: null text counts as empty (its end id only); repeated rows are written each, in any order among
themselves; a null doc_id comes first; further columns are ignored; an empty table gives no stripe.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, fresh, text_batches, text_or_empty, tidied
from .tokens import json_encoder, vocabulary

#: Ids of a stripe, at least; the end id; ids are below the limit. Bytes of text of a part, and the most parts.
STRIPE, END_ID, LIMIT, PART, PARTS = 1 << 16, 2, 50_257, 24 << 20, 100_000

_STRIPES = pa.schema([
    ("part", pa.int32()), ("nth", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("ids", pa.binary())
])


def _classes(spark: SparkSession) -> dict:
    """The coder's classes, loaded in the driver and known to all executors; compiled once for a Spark context."""
    sc = spark.sparkContext
    if not hasattr(sc, "_graphloom_ids"):
        jvm = sc._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(Path(__file__).with_name("IdMixer.java").read_text())
        code, jar = compiler.getBytecodes(), io.BytesIO()
        with zipfile.ZipFile(jar, "w") as z:
            for name in code:
                z.writestr(name.replace(".", "/") + ".class", bytes(code[name]))
        path = jvm.org.apache.hadoop.fs.Path(fresh(spark, "coder") + ".jar")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        out.write(jar.getvalue())
        out.close()
        spark.sql(f"ADD JAR '{path.toString()}'")
        loader = jvm.Thread.currentThread().getContextClassLoader()
        sc._graphloom_ids = {k: loader.loadClass(f"graphloom.{k}") for k in ("EncodeIds", "DecodeIds")}
    return sc._graphloom_ids


def _call(spark: SparkSession, kind: str, result: str, *args: Column) -> Column:
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    made = _classes(spark)[kind].getDeclaredConstructor(gateway.new_array(jvm.Class, 0)).newInstance(gateway.new_array(jvm.Object, 0))
    spark._jsparkSession.udf().register(f"graphloom_{kind}", made, jvm.org.apache.spark.sql.types.DataType.fromDDL(result))
    return F.call_function(f"graphloom_{kind}", *args)


def encoded(spark: SparkSession, ids: Column, limit: int) -> Column:
    """A stripe of ids (little-endian, 32 bits, below limit)."""
    return _call(spark, "EncodeIds", "binary", ids, F.lit(limit))


def decoded(spark: SparkSession, data: Column, offsets: Column) -> Column:
    """The ids of each document of a stripe, whose first ids are at the offsets."""
    return _call(spark, "DecodeIds", "array<binary>", data, offsets)


@tidied
def _stripes(batches: Iterator[pa.RecordBatch], vocab, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, nth, before = TaskContext.get().partitionId(), 0, 0
    encoder = json_encoder(vocab.value.decode())
    held: list[tuple[list, np.ndarray, np.ndarray]] = []
    waiting = 0

    def stripe() -> pa.RecordBatch:
        counts = np.concatenate([c for _, c, _ in held])
        row = part, nth, before, waiting, [x for d, _, _ in held for x in d], np.cumsum(counts) - counts, np.concatenate([i for _, _, i in held]).astype("<u4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _STRIPES.types, strict=True)], schema=_STRIPES)

    for batch in text_batches(batches, "text", 6 << 20):
        doc_ids = batch.column("doc_id").to_pylist()
        ids, counts = encoder.encode(batch.column("text"))
        ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
        ends, at = np.cumsum(counts), 0
        while at < len(counts):
            begin = int(ends[at] - counts[at])
            to = min(len(counts), int(np.searchsorted(ends, begin + STRIPE - waiting)) + 1)
            held.append((doc_ids[at:to], counts[at:to], ids[begin : ends[to - 1]]))
            waiting, at = waiting + int(ends[to - 1]) - begin, to
            if waiting >= STRIPE:
                yield stripe()
                nth, before, held, waiting = nth + 1, before + waiting, [], 0
    if held:
        yield stripe()


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in ascending doc_id order, to a new folder."""
    spark = docs.sparkSession
    vocab = vocabulary(spark, path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = rows.repartitionByRange(min(PARTS, buckets_for(rows, "text", PART)), "doc_id").sortWithinPartitions("doc_id")
    stripes = ordered.mapInArrow(lambda it: _stripes(it, vocab, end_id), "part int, nth bigint, before bigint, n bigint, doc_ids array<bigint>, offsets array<bigint>, ids binary")
    stripes.withColumn("data", encoded(spark, F.col("ids"), limit)).drop("ids").write.option("compression", "uncompressed").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    stripes = spark.read.schema("part int, nth bigint, before bigint, n bigint, doc_ids array<bigint>, offsets array<bigint>, data binary").parquet(folder)
    parts = stripes.groupBy("part").agg(F.sum("n").alias("own"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part, at most PARTS
    bases = parts.select("part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"))
    rows = stripes.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("first"), F.inline(F.arrays_zip("doc_ids", "offsets", decoded(spark, F.col("data"), F.col("offsets")).alias("ids"))))
    return rows.select(F.col("doc_ids").alias("doc_id"), (F.col("first") + F.col("offsets")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def token_roundtrip(docs: DataFrame, path: str) -> DataFrame:
    folder = fresh(docs.sparkSession, "tokens")
    write_tokens(docs, path, folder)
    return read_tokens(docs.sparkSession, folder)
