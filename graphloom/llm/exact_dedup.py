"""Exact deduplication by content-defined chunk recipes.

A text is normalised (A-Z lower-cased, nothing else) and cut where a rolling hash of its bytes says so. Identifiers are
digests that are verified: each distinct chunk of a batch is moved once, equal ones are merged before and after, and a
digest under which more than one body is left gives each of them an identifier of its own, so chunks share an identifier
only if their bytes are equal. A document is then its ordered list of identifiers, and equal lists are equal texts.

No step needs the rows of a chunk or of a group of copies together: bodies are merged as keys, lists are gathered by
row, and the rows of a large group are dealt to many tasks when they learn which of them stays.

Defined cases: null text counts as empty; empty texts are one group; repeated rows are a group in which one row stays;
a null doc_id sorts below all others; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, settle, text_batches, text_or_empty, tidied

#: Chunk sizes in bytes: none below, none above, and 1 / 2**CUT_BITS of positions are cut points.
LEAST, MOST, CUT_BITS = 256, 8192, 10
#: Digests of chunks; the second is a poor one, for tests.
DIGESTS = {"blake2b": lambda body: hashlib.blake2b(body, digest_size=16).digest(), "length": lambda body: bytes([len(body) % 7])}
_K8, _K16 = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

_ROWS = "digest binary, body binary, uses array<struct<row_id:bigint,doc_id:bigint,pos:int,sha:string>>"
_USE = pa.struct([("row_id", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("sha", pa.string())])
_ARROW = pa.schema([("digest", pa.binary()), ("body", pa.binary()), ("uses", pa.list_(_USE))])


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of data; they depend on the 16 bytes before them and the chunk's own start only."""
    n = len(data)
    if n <= 2 * LEAST:
        return [n]
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    h = b[: n - 7].copy()
    for k in range(1, 8):
        h *= _K8
        h += b[k : n - 7 + k]
    h = (h[:-8] * _K8 + h[8:]) * _K16
    ends, last = [], 0
    for p in (np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 16).tolist():
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST and n - p >= LEAST:
            ends.append(last := p)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


@tidied
def _chunks(batches: Iterator[pa.RecordBatch], digest_of: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    name = DIGESTS[digest_of]

    row_id = TaskContext.get().partitionId() << 40
    for batch in text_batches(batches, "text", 4 << 20):
        found: dict[bytes, tuple[bytes, list]] = {}
        other = []  # the same digest with other bytes within a batch
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = text.encode().lower()
            sha, start = hashlib.sha256(data).hexdigest(), 0
            for pos, end in enumerate(cut_points(data)):
                body = data[start:end]
                use = {"row_id": row_id, "doc_id": doc_id, "pos": pos, "sha": sha if pos == 0 else None}
                held = found.setdefault(digest := name(body), (body, []))
                (held[1] if held[0] == body else other.append((digest, body, [use])) or []).append(use)
                start = end
            row_id += 1
        rows = [(d, *x) for d, x in found.items()] + other
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW.types)], schema=_ARROW)


def chunk_of(digest: str) -> Column:
    return F.lower(F.hex(digest))


def _identified(rows: DataFrame) -> DataFrame:
    """rows with their chunks' identifiers: the digest, and a number where different bodies share one."""
    bodies = rows.select("digest", "body").distinct()
    doubtful = settle(bodies.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "doubtful")
    chunk = chunk_of("digest")
    if doubtful.isEmpty():
        return rows.withColumn("chunk", chunk)
    variant = F.dense_rank().over(Window.partitionBy("digest").orderBy("body"))
    numbered = bodies.join(doubtful, "digest").withColumn("variant", variant)
    sizes = rows.join(doubtful, "digest").groupBy("digest", "body").agg(F.count("*").alias("rows"))
    found = numbered.join(sizes, ["digest", "body"]).withColumn("both", F.struct("digest", "body")).select("both", "variant", "rows")
    odd = rows.join(doubtful, "digest").withColumns({"both": F.struct("digest", "body"), "own": F.col("uses")[0]["row_id"]})
    named = join_groups(odd, found, "both", "rows", "own").select("uses", F.concat(chunk_of("both.digest"), F.lit("."), F.col("variant").cast("string")).alias("chunk"))
    return rows.join(doubtful, "digest", "left_anti").select("uses", chunk.alias("chunk")).unionByName(named)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str = "blake2b") -> DataFrame:
    """Per row: row_id, doc_id, sha256 of the normalised text, and the ordered list of its verified chunk identifiers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(lambda it: _chunks(it, digest), _ROWS)
    uses = _identified(settle(rows, "chunks")).select("chunk", F.inline("uses"))
    return uses.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"),
        F.expr("array_join(transform(array_sort(collect_list(struct(pos, chunk))), x -> x.chunk), ',')").alias("recipe"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str = "blake2b") -> DataFrame:
    """One row per input row: doc_id, keep_id (the largest doc_id of its group), group_size, kept, text_sha256."""
    rows = settle(recipes(docs, id_col, text_col, digest), "recipes")
    groups = settle(rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return join_groups(rows, groups, "recipe", "group_size", "row_id").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
