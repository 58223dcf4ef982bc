"""Byte-level BPE over a global table of distinct pre-tokens.

Texts are cut into pre-tokens. A batch numbers its distinct ones; the numbers in the order of their positions stay in a
file of the shared folder, and the distinct pre-tokens go, as blobs, to the bucket of their hash. There equal ones of
all batches meet, each distinct one is encoded once, and ids go back to the batches that asked, which put their
documents together by position. Decoding looks ids up in the table of token bytes.

A batch asks for a pre-token once, so the most frequent one has as many rows as there are batches, not positions. A
batch's file has a new name in each attempt of its task; should a task run again, either file serves, being equal.

Defined cases: null text counts as empty (no ids); repeated rows are encoded each; a null doc_id is kept; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, fresh, text_batches, text_or_empty, tidied
from .tokens import gather, vocabulary

BATCH, BUCKET = 9 << 20, 24 << 20

_ASKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("path", pa.string()), ("begin", pa.int64()), ("size", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("words", pa.binary())])


def pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte plane by byte plane, which packs better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplane(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


@tidied
def _number(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, folder: str) -> Iterator[pa.RecordBatch]:
    import regex
    from pyspark import TaskContext

    find, number = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    path, out, begin = f"{root}/{uuid.uuid4().hex}", None, 0
    for batch in text_batches(batches, "text", BATCH):
        codes: dict[str, int] = defaultdict()
        codes.default_factory = codes.__len__
        parts = []
        for text in batch.column("text"):
            own = find(text.as_py())
            parts.append(np.fromiter(map(codes.__getitem__, own), np.uint32, len(own)))
        doc_ids, sizes = batch.column("doc_id").to_pylist(), np.array([len(p) for p in parts], "<u4")
        known = np.array([x is not None for x in doc_ids], np.uint8)
        data = pack(np.array([len(doc_ids), sizes.sum()], "<u8").tobytes(), known.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), sizes.tobytes(), planes(np.concatenate(parts)))
        out = out or fs.open_output_stream(path, compression=None)
        out.write(data)
        words = [w.encode() for w in codes]
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
        rows = [(number % buckets, number, path, begin, len(data), 0, pack(), pack())]  # so that a batch without pre-tokens is known too
        for a, b in zip(at, [*at[1:], len(words)], strict=True):
            own = [words[i] for i in order[a:b].tolist()]
            rows.append((int(bucket[order[a]]), number, path, begin, len(data), b - a, pack(planes(order[a:b])), pack(planes(np.array(list(map(len, own)))), *own)))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 256]], t) for k, t in enumerate(_ASKED.types)], schema=_ASKED)
        number, begin = number + 1, begin + len(data)
    if out:
        out.close()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.splitlines()))}


@tidied
def _encode(asked: pd.DataFrame, ranks, pattern: str) -> pd.DataFrame:
    """One bucket: ids of its distinct pre-tokens, back to the batches that asked, in the order in which they asked."""
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(ranks.value), special_tokens={})._encode_single_piece
    places: dict[bytes, int] = defaultdict()
    places.default_factory = places.__len__
    wanted = []
    for n, data in zip(asked["n"], asked["words"], strict=True):
        raw = unpack(data)
        ends = 4 * n + np.cumsum(unplane(raw, n), dtype=np.int64)
        starts = [4 * n, *ends.tolist()]
        wanted.append(np.fromiter((places[raw[a:b]] for a, b in zip(starts, starts[1:])), np.int64, n))
    ids = [np.array(encode(w), "<u4") for w in places]
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, starts = np.concatenate([*ids, np.zeros(0, "<u4")]), np.cumsum(lens) - lens
    out = asked[["batch", "path", "begin", "size", "n", "codes"]].copy()
    out["lens"] = [pack(planes(lens[w])) for w in wanted]
    out["ids"] = [pack(planes(gather(flat, starts[w], lens[w]))) for w in wanted]
    return out


@tidied
def _assemble(frame: pd.DataFrame, folder: str) -> pd.DataFrame:
    """One batch: ids of its documents."""
    fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
    row = frame.iloc[0]
    with fs.open_input_file(row["path"]) as f:
        f.seek(int(row["begin"]))
        raw = unpack(f.read(int(row["size"])))
    docs, total = np.frombuffer(raw, "<u8", 2).tolist()
    known, at = np.frombuffer(raw, np.uint8, docs, 16), 16 + docs
    doc_ids, sizes = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, "<u4", docs, at + 8 * docs).astype(np.int64)
    codes = unplane(raw, total, at + 12 * docs)
    n = frame["n"].to_numpy()
    order = np.concatenate([unplane(unpack(x), k) for x, k in zip(frame["codes"], n, strict=True)])
    own = np.concatenate([unplane(unpack(x), k) for x, k in zip(frame["lens"], n, strict=True)]).astype(np.int64)
    flat = np.concatenate([unplane(raw, len(raw) // 4) for raw in map(unpack, frame["ids"])])
    lens, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    lens[order], starts[order] = own, np.cumsum(own) - own
    out, at = [], 0
    for n in sizes.tolist():
        part, at = codes[at : at + n], at + n
        out.append(gather(flat, starts[part], lens[part]).astype("<u4").tobytes())
    return pd.DataFrame({"doc_id": pd.Series(pd.array(doc_ids, "Int64")).mask(known == 0), "ids": out})


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    ranks, folder = vocabulary(spark, path), fresh(spark, "positions")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    buckets = buckets_for(rows, "text", BUCKET)
    place = "batch bigint, path string, begin bigint, size bigint, n bigint, codes binary"
    asked = rows.mapInArrow(lambda it: _number(it, pattern, buckets, folder), f"bucket bigint, {place}, words binary")
    answered = asked.groupBy("bucket").applyInPandas(lambda f: _encode(f, ranks, pattern), f"{place}, lens binary, ids binary")
    return answered.groupBy("batch").applyInPandas(lambda f: _assemble(f, folder), "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encode_documents with their text's bytes beside the ids."""
    ranks = vocabulary(encoded.sparkSession, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted((rank, token) for token, rank in parse_ranks(ranks.value).items())
        lens = np.zeros(table[-1][0] + 1, np.int64)
        for rank, token in table:
            lens[rank] = len(token)
        flat, starts = np.frombuffer(b"".join(t for _, t in table), np.uint8), np.cumsum(lens) - lens
        for batch in batches:
            for part in text_batches(iter([batch]), "ids", 4 << 20):
                texts = []
                for ids in part.column("ids").to_pylist():
                    at = np.frombuffer(ids, "<u4")
                    texts.append(gather(flat, starts[at], lens[at]).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(decode, "doc_id bigint, ids binary, decoded binary")


