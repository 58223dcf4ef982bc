"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a skippable frame that holds the seek table (of each
frame its compressed and plain size, first record and number of records) and the record identifiers with their
offsets within their frames. One record is read by seeking to the table, then decompressing one frame.

Of records with equal payloads of at least 100 bytes, the one with the smallest page_id is a response and the others
are revisits that refer to it; shorter payloads are always responses.

Defined cases: null html counts as empty; repeated rows that carry the smallest page_id of their payload are all
responses; a null page_id sorts last; further columns are ignored; an empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_groups, settle, text_batches, tidied

FRAME_BYTES, BUNDLE_BYTES, REVISIT_FROM = 256 << 10, 64 << 20, 100
#: Fixed values of the formats: skippable frame of the seek table, its closing mark.
SKIPPABLE, MARK = 0x184D2A5E, 0x8F92EAB1


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, size: int) -> bytes:
    """One WARC/1.1 record; a revisit has headers only, its length and digest are those of the payload it stands for."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    body = b"" if revisit else payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record that begins at the offset, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    heads = dict(x.split(": ", 1) for x in lines)
    body = data[end + 4 : (stop := end + 4 + int(heads["Content-Length"]))]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return heads, body, stop + 4


class BundleWriter:
    """Writes one bundle to a file object, one frame in memory at a time."""

    def __init__(self, out):
        self.out, self.frames, self.index, self.buffer, self.held, self.written = out, [], [], [], 0, 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append((page_id, len(self.frames), self.held))
        self.buffer.append(data)
        self.held += len(data)
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            plain = b"".join(self.buffer)
            packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(plain)
            self.out.write(packed)
            self.frames.append((self.written, len(packed), len(plain)))
            self.written += len(packed)
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = zstandard.ZstdCompressor().compress(json.dumps({"frames": self.frames, "records": self.index}).encode())
        body = table + struct.pack("<II", len(table), MARK)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class BundleReader:
    """Random access to a bundle; f needs seek() and read()."""

    def __init__(self, f):
        self.f = f
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 8)
        size, mark = struct.unpack("<II", f.read(8))
        if mark != MARK:
            raise ValueError("no seek table: the bundle is cut short")
        f.seek(end - 8 - size)
        table = json.loads(zstandard.ZstdDecompressor().decompress(f.read(size)))
        self.frames, self.records = table["frames"], table["records"]
        self.places = {page_id: (k, at) for page_id, k, at in reversed(self.records)}  # the first of each identifier

    def frame(self, k: int) -> bytes:
        at, size, plain = self.frames[k]
        self.f.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.f.read(size), max_output_size=plain)

    def get(self, page_id: int | None) -> tuple[dict[str, str], bytes]:
        k, at = self.places[page_id]
        return parse(self.frame(k), at)[:2]

    def __iter__(self) -> Iterator[tuple[int | None, dict[str, str], bytes]]:
        held, data = -1, b""
        for page_id, k, at in self.records:
            if k != held:
                held, data = k, self.frame(k)
            yield page_id, *parse(data, at)[:2]


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    done, writer, out, path = [], None, None, ""

    def close():
        writer.close()
        out.close()
        done.append((path, len(writer.index)))

    for batch in batches:
        for r in batch.to_pylist():
            if writer and writer.written >= BUNDLE_BYTES:
                close()
                writer = None
            if not writer:  # the name is new in each attempt: a file counts only once its task has listed it
                path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                out = fs.open_output_stream(path, compression=None)
                writer = BundleWriter(out)
            payload = r["payload"] or b""
            writer.add(r["page_id"], record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"], r["revisit"], r["size"]))
    if writer:
        close()
    yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "records": [x[1] for x in done]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows: list[tuple] = []
            with fs.open_input_file(path) as f:
                for _, heads, body in BundleReader(f):
                    revisit = heads["WARC-Type"] == "revisit"
                    digest = heads["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload of {heads['WARC-Record-ID']} in {path} differs from its digest")
                    rows.append((number(heads["WARC-Record-ID"]), int(heads["X-Payload-Length"]) if revisit else len(body), digest, heads["WARC-Type"], number(heads.get("WARC-Refers-To")), heads.get("WARC-Target-URI")))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("size", pa.int64())])


@tidied
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of payloads; a payload that equals an earlier one of its batch under a smaller page_id, and so will be a revisit, is left out."""
    key = lambda p: (p is None, p or 0)
    for batch in text_batches(batches, "payload"):
        ids, payloads = batch.column("page_id").to_pylist(), batch.column("payload").to_pylist()
        digests = [hashlib.sha256(x).hexdigest() for x in payloads]
        least: dict[str, tuple] = {}
        for p, d in zip(ids, digests, strict=True):
            least[d] = min(least.get(d, key(p)), key(p))
        kept = [x if len(x) < REVISIT_FROM or key(p) == least[d] else None for p, x, d in zip(ids, payloads, digests, strict=True)]
        columns = batch.column("page_id"), batch.column("url"), kept, digests, [len(x) for x in payloads]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _PAGES.types, strict=True)], schema=_PAGES)


def plan_records(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, payload (null for revisits), digest, size, revisit, refers_to.

    Only digests and ids are grouped. Of a batch's equal payloads one goes on to the join, so what moves of a page that a
    third of all rows hold is a payload per batch; its rows are dealt to many tasks.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = settle(rows.mapInArrow(_digests, "page_id bigint, url string, payload binary, digest string, size bigint"), "pages")
    order = F.struct(F.col("page_id").isNull().alias("z"), "page_id")
    firsts = rows.groupBy("digest").agg(F.min(order).alias("o"), F.count("*").alias("n"), F.max("size").alias("bytes"))
    firsts = settle(firsts.select("digest", F.when((F.col("n") > 1) & (F.col("bytes") >= REVISIT_FROM), F.col("o.page_id")).alias("first"), "n"), "firsts")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return join_groups(rows.withColumn("own", F.xxhash64("page_id", "url")), firsts, "digest", "n", "own").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size", again.alias("revisit"), F.when(again, F.col("first")).alias("refers_to")
    )


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write the bundles; returns the table of (path, records), which alone says what belongs to the archive."""
    schema = "path string, records bigint"
    return settle(plan_records(pages).mapInArrow(lambda it: _write(it, folder), schema), "warc-manifest")


def read_bundles(manifest: DataFrame, folder: str) -> DataFrame:
    n = max(1, manifest.count())
    spread = manifest.repartition(min(n, 10_000), "path")
    return spread.mapInArrow(lambda it: _read(it, folder), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def archive_roundtrip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = fresh(spark, "warc")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return read_bundles(write_bundles(pages, folder), folder).drop("url")
