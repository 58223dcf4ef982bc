"""N-gram Jaccard self-join by a prefix tree, and the components of its links.

A document is the set of its distinct 5-word shingles. Shingles are ordered globally, rare ones first. Two sets of
Jaccard similarity 0.8 or more share a shingle among the first n - ceil(0.8 n) + 1 of each (its prefix), so only
documents with a shared shingle in their prefix are looked at further, and of their sets only shared shingles.

Sets are verified in tries: the ordered sets that face one probe set are stored in a trie, which is traversed with the
overlap so far, each common beginning once; a subtree is left as soon as its longest remainder cannot bring the
overlap that its least demanding set needs.

Equal sets are one class from the start. Components need no list of all links: first each class faces the purest
class (fewest unshared shingles) among those that share its prefix; then, within each prefix shingle, all pairs whose
classes are still in different components are verified, but for pairs that their sizes or places rule out. No link
between different components is left out, and a large group of near copies is joined in linear time.

Shingles are compared by 64-bit hashes: two documents could be taken for linked by chance in about n^2 / 2^64 of pairs.

Defined cases: null and wordless texts have no shingle and stand alone; one to four words are one shingle; repeated
rows are equal sets; a null doc_id joins its component, whose component_id is the least other doc_id (null if there is
none); further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, buckets_for, join_groups, release, settle, text_batches, text_or_empty, tidied
from .components import components

BATCH, BUCKET, N = 9 << 20, 8 << 20, 5
#: Links need 100 * intersection >= PERCENT * union; sets that one trie holds.
PERCENT, TRIE = 80, 256
#: Tokens of one shingle that one task takes; beyond SALTS times as many, more.
DEALT = 2000

_NUMBERED = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("codes", pa.binary()), ("hashes", pa.binary())])
_U = np.uint64


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


@tidied
def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in text_batches(batches, "text", BATCH):
        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        parts = []
        for text in batch.column("text"):
            own = text.as_py().encode().lower().split()
            parts.append(np.fromiter(map(words.__getitem__, own), np.uint32, len(own)))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        row = [number], [batch.column("doc_id").to_pylist()], [np.array([len(p) for p in parts], "<u4").tobytes()], [pack(np.concatenate(parts))], [pack(hashes)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _NUMBERED.types, strict=True)], schema=_NUMBERED)
        number += 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_sets(words: np.ndarray, sizes: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """From the word hashes of all documents: distinct shingle hashes by document, sorted, and their numbers."""
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(words))  # words of the document from here on
    h = np.zeros(len(words), _U)
    for k in range(n):
        there = left > k
        step = np.zeros(len(words), _U)
        step[: len(words) - k if k else len(words)] = words[k:]
        h = np.where(there, _mix((h + step) * _U(0x9E3779B97F4A7C15) + _U(k + 1)), h)
    first = np.arange(len(words)) == np.repeat(ends - sizes, sizes)
    full = (left >= n) | (first & (np.repeat(sizes, sizes) < n))
    doc, h = doc[full], h[full]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(sizes))


def _batch_sets(row: dict, buckets: int, shift: int):
    """Sets of a batch, keys of equal sets, which are first of their key; distinct leading bits of these shingles by (bucket, bits)."""
    sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
    words = np.frombuffer(unpack(row["hashes"]), "<u8")[np.frombuffer(unpack(row["codes"]), "<u4")]
    h, counts = shingle_sets(words, sizes)
    ends = np.cumsum(counts)
    keys = [hashlib.blake2b(h[e - c : e].tobytes(), digest_size=16).digest() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
    firsts: dict[bytes, int] = {}
    first = np.array([firsts.setdefault(k, i) == i for i, k in enumerate(keys)], bool)
    own = np.repeat(first, counts)
    distinct, times = np.unique(h[own] >> _U(shift), return_counts=True)
    bucket = distinct % _U(buckets)
    order = np.argsort(bucket, kind="stable")
    return h, counts, keys, first, distinct[order], times[order], bucket[order].astype(np.int64)


def _runs(bucket: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return list(zip(at, [*at[1:], len(bucket)], strict=True))


@tidied
def _send(batches: Iterator[pa.RecordBatch], buckets: int, shift: int) -> Iterator[pa.RecordBatch]:
    names, types = ["bucket", "batch", "n", "data"], (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            *_, distinct, times, bucket = _batch_sets(row, buckets, shift)
            rows = [(int(bucket[a]), row["batch"], b - a, pack(np.diff(distinct[a:b], prepend=_U(0)), times[a:b].astype("<u4"))) for a, b in _runs(bucket)]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 64]], t) for k, t in enumerate(types)], names=names)


@tidied
def _frequencies(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket: how many sets hold shingles of these bits, told to each batch in the order of its question."""
    sent = []
    for n, data in zip(frame["n"], frame["data"], strict=True):
        raw = unpack(data)
        sent.append((np.cumsum(np.frombuffer(raw, "<u8", n), dtype=_U), np.frombuffer(raw, "<u4", n, 8 * n)))
    _, at = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
    total = np.minimum(np.bincount(at, np.concatenate([x[1] for x in sent])), 0xFFFFFFFF).astype("<u4")[at]
    ends = np.cumsum(frame["n"].to_numpy())
    return pd.DataFrame({"batch": frame["batch"], "bucket": frame["bucket"], "n": frame["n"], "data": [pack(total[e - n : e]) for n, e in zip(frame["n"], ends, strict=True)]})


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-n * PERCENT // 100) + 1


@tidied
def _describe(batch: pd.DataFrame, back: pd.DataFrame, buckets: int, shift: int) -> pd.DataFrame:
    """Per document: n, key, whether first of its key in the batch; of those with a shared shingle in their prefix, all shared ones in global order."""
    if not len(batch):
        return pd.DataFrame({k: [] for k in ("doc_id", "n", "key", "shared")})
    row = batch.iloc[0]
    h, counts, keys, first, distinct, _, bucket = _batch_sets(row, buckets, shift)
    answers = dict(zip(back["bucket"], back["data"], strict=True))
    df = np.concatenate([np.frombuffer(unpack(answers[int(bucket[a])]), "<u4") for a, _ in _runs(bucket)] + [np.zeros(0, "<u4")])
    order = np.argsort(distinct)
    distinct, df = distinct[order], df[order]
    often = df[np.searchsorted(distinct, h >> _U(shift))].astype(np.int64) if len(h) else np.zeros(0, np.int64)
    ends, prefix = np.cumsum(counts), prefix_length(counts)
    alone = np.bincount(np.repeat(np.arange(len(counts)), counts), often == 1, len(counts)).astype(np.int64)
    shared: list[np.ndarray | None] = [None] * len(counts)
    for i in np.flatnonzero(first & (counts > 0) & (alone < prefix)).tolist():
        own, f = h[ends[i] - counts[i] : ends[i]], often[ends[i] - counts[i] : ends[i]]
        own = own[np.lexsort((own, f))][alone[i] :]
        shared[i] = own.view(np.int64)
    return pd.DataFrame({"doc_id": pd.array(row["doc_ids"], "Int64"), "n": counts.astype(np.int64), "key": keys, "shared": shared})


class Trie:
    """Ordered sets, with what each subtree needs: its longest set and the least overlap that any of its sets asks for."""

    def __init__(self):
        self.root = [{}, 0, 1 << 62, []]

    def add(self, ordered, need: int, name) -> None:
        node, size = self.root, len(ordered)
        for x in ordered:
            node[1], node[2] = max(node[1], size), min(node[2], need)
            if x not in node[0]:
                node[0][x] = [{}, 0, 1 << 62, []]
            node = node[0][x]
        node[1], node[2] = max(node[1], size), min(node[2], need)
        node[3].append((name, need))

    def reach(self, probe: set) -> Iterator[tuple]:
        """(name, overlap) of the sets whose overlap with the probe is as large as they need."""
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if overlap + node[1] - depth < node[2]:
                continue
            for name, need in node[3]:
                if overlap >= need:
                    yield name, overlap
            for x, child in node[0].items():
                stack.append((child, depth + 1, overlap + (x in probe)))


def needed_overlap(a: int, b: int) -> int:
    """Least intersection with 100 * i >= PERCENT * (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _verify(members: pd.DataFrame, probe: pd.DataFrame) -> pd.DataFrame:
    if not len(members) or not len(probe):
        return pd.DataFrame({"u": [], "v": []})
    own, trie = probe.iloc[0], Trie()
    for cid, n, shared in zip(members["cid"], members["n"], members["shared"], strict=True):
        trie.add(shared.tolist(), needed_overlap(int(own["own_n"]), int(n)), cid)
    found = [cid for cid, _ in trie.reach(set(own["own"].tolist()))]
    return pd.DataFrame({"u": np.full(len(found), own["p"], np.int64), "v": np.array(found, np.int64)})


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) among distinct pairs (probe, cid); a probe's members are dealt to tries of about TRIE sets."""
    pairs = settle(pairs, "pairs")
    tries = pairs.groupBy("probe").agg(F.ceil(F.count("*") / TRIE).alias("tries"))
    dealt = pairs.join(tries, "probe").withColumn("trie", F.pmod(F.xxhash64("cid"), "tries"))
    members = dealt.join(sets.select("cid", "n", "shared"), "cid")
    probes = dealt.select(F.col("probe").alias("p"), F.col("trie").alias("t")).distinct().join(sets.select(F.col("cid").alias("p"), F.col("n").alias("own_n"), F.col("shared").alias("own")), "p")
    return members.groupBy("probe", "trie").cogroup(probes.groupBy("p", "t")).applyInPandas(_verify, "u bigint, v bigint")


def _similar_sizes(a: str, b: str):
    return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    buckets = buckets_for(rows, "text", BUCKET)
    # Frequencies are counted by leading bits, ten more than shingles could need: a chance meeting only makes a shingle
    # look less rare, and in the same way to all documents.
    shift = max(0, 64 - (buckets * BUCKET).bit_length() - 10)
    numbered = settle(rows.mapInArrow(_number, "batch bigint, doc_ids array<bigint>, sizes binary, codes binary, hashes binary"), "shingled")
    sent = numbered.mapInArrow(lambda it: _send(it, buckets, shift), "bucket bigint, batch bigint, n bigint, data binary")
    answers = sent.groupBy("bucket").applyInPandas(lambda f: _frequencies(f), "batch bigint, bucket bigint, n bigint, data binary").withColumnRenamed("batch", "of")
    described = numbered.groupBy("batch").cogroup(answers.groupBy("of")).applyInPandas(lambda a, b: _describe(a, b, buckets, shift), "doc_id bigint, n bigint, key binary, shared array<bigint>")
    out = settle(described, "described")
    del sent, answers, described
    release(docs.sparkSession, numbered)
    return out


def _between_components(tokens: DataFrame) -> DataFrame:
    """Distinct pairs (probe, cid) of classes in different components that share a prefix shingle and whose sizes and places in it allow a link.

    tokens: h, cid, n, at, root, most (the root that h has most often) and all (how many tokens h has). Links join sizes
    within a ratio of PERCENT, so tokens meet by steps of size as well as by h; those of a frequent h are dealt to tasks.
    What sizes and places rule out is ruled out inside the join. Unlike classes of like sizes that share a prefix shingle,
    and so some four fifths of their rarest shingles with other texts, are still compared pair by pair.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT) + 1e-9)
    deals = F.least(F.ceil(F.col("all") / DEALT), F.lit(SALTS)).cast("int")
    a = tokens.filter("root <> most").select(
        F.col("h").alias("a_h"), *(F.col(c).alias(f"a_{c}") for c in ("cid", "n", "at", "root")), F.explode(F.array(step - 1, step, step + 1)).alias("a_step"), deals.alias("deals")
    ).withColumn("a_deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    b = tokens.select("h", "cid", "n", "at", "root", step.alias("step"), F.pmod(F.xxhash64("cid"), deals).cast("int").alias("deal"))
    bound = F.expr(f"{100 + PERCENT} * least(n - at, a_n - a_at) >= {PERCENT} * (n + a_n)")
    met = (F.col("h") == F.col("a_h")) & (F.col("step") == F.col("a_step")) & (F.col("deal") == F.col("a_deal"))
    pairs = a.join(b, met & (F.col("root") != F.col("a_root")) & _similar_sizes("n", "a_n") & bound)
    return pairs.select(F.greatest("cid", "a_cid").alias("probe"), F.least("cid", "a_cid").alias("cid")).distinct()


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, class_id (least doc_id with the same set) and class_size."""
    rows = describe(docs, id_col, text_col)
    classes = settle(rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    one = Window.partitionBy("key").orderBy("doc_id")  # one row of each batch at most
    sets = rows.filter("shared is not null").withColumn("r", F.row_number().over(one)).filter("r = 1").join(classes.select("key", "cid"), "key").select("cid", "n", "shared")
    sets = sets.withColumn("alone", F.col("n") - F.size("shared"))
    prefix = F.slice("shared", 1, (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - F.col("alone")).cast("int"))
    tokens = settle(sets.select("cid", "n", "alone", F.posexplode(prefix).alias("at", "h")).withColumn("at", F.col("at") + F.col("alone")), "prefixes")

    purity = F.struct((F.col("alone") / F.col("n")).alias("x"), F.col("cid").alias("probe"), F.col("n").alias("m"))
    leaders = settle(tokens.groupBy("h").agg(F.min(purity).alias("lead"), F.count("*").alias("k")).filter("k > 1"), "leaders")
    facing = join_groups(tokens, leaders, "h", "k", "cid").filter(F.col("cid") != F.col("lead.probe")).filter(_similar_sizes("n", "lead.m"))
    votes = facing.groupBy("cid", F.col("lead.probe").alias("probe")).agg(F.count("*").alias("votes"))
    stars = votes.groupBy("cid").agg(F.max(F.struct("votes", "probe")).alias("best")).select(F.col("best.probe").alias("probe"), "cid")
    near = settle(verified(stars, sets), "links")

    roots = components(near)
    rooted = tokens.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = settle(rooted, "rooted")
    shares = rooted.groupBy("h", "root").agg(F.count("*").alias("k"))
    most = shares.groupBy("h").agg(F.max(F.struct("k", "root")).alias("most"), F.count("*").alias("roots"), F.sum("k").alias("all")).filter("roots > 1")
    open_ = settle(join_groups(rooted, settle(most.select("h", F.col("most.root").alias("most"), "all"), "most"), "h", "all", "cid"), "open")
    rest = _between_components(open_)
    more = settle(verified(rest, sets), "links")

    joined = more.select(F.col("u").alias("node"), F.col("v").alias("other"))
    start = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(joined.select(F.col("node").alias("u"), F.col("other").alias("v")))
    whole = components(start)
    named = classes.join(whole.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lows = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(lows, "root").select("key", "component_id", "class_id", "class_size")
    out = join_groups(rows.filter("n > 0").select("doc_id", "n", "key"), settle(named, "named"), "key", "class_size", "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", "class_size")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionAll(alone)
