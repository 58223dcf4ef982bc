"""Katz backoff scores of documents: Good-Turing discounted bigrams with exactly normalised backoff weights.

Tokens are words (A-Z lower-cased) and one end per document, which is also the context of a document's first token. A
word seen in training has P1(w) = d(c) c / N; what the unigram discounts leave belongs to the one class of all unknown
words, so that P1 sums to 1. P(w | h) = d2(c(h, w)) c(h, w) / c(h) for bigrams seen, else alpha(h) P1(w), where
alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P1(w) over seen w). A context whose discounts leave nothing
counts one more than it has, so that something is left; an unseen context passes on to P1.

How it runs: a batch of texts numbers its words; distinct words are shuffled once for their counts and dense global
ids, and come back to their batches. A batch sends its distinct bigrams, with training counts, as sorted blobs to
buckets (by context; contexts with more tokens than a bucket should hold are split by their second word). A bucket
sums counts, stores its part of the bigram table, and returns to each batch, in the order that it was sent, the
totals and the statistics of its contexts; sums of split contexts are added up apart (at most SPLIT rows). A learnt
context that stands before unknown words only in its batch has no bigram to send and asks for its statistics alone.

Defined cases: null text counts as empty (its end only); a null doc_id is neither held out nor learnt from; repeated
rows are learnt from and scored each; without training documents everything is unknown; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, release, settle, text_batches, text_or_empty, tidied

BATCH, BUCKET, SPLIT = 14 << 20, 12 << 20, 500_000
#: Counts up to K are discounted.
K = 5
END = "\n"  # no word holds white space

_NUMBERED = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("roles", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32()))])


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


@tidied
def _number(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in text_batches(batches, "text", limit):
        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        end = words[END.encode()]
        parts, sizes, roles = [], [], batch.column("role").to_pylist()
        for text in batch.column("text"):
            own = text.as_py().encode().lower().split()
            parts.append(np.fromiter(map(words.__getitem__, own), np.uint32, len(own)))
            parts.append(np.array([end], np.uint32))
            sizes.append(len(own) + 1)
        codes, learn = np.concatenate(parts), np.repeat(np.array(roles) == 0, sizes)
        counts = np.bincount(codes[learn], minlength=len(words))
        row = [number], [batch.column("doc_id").to_pylist()], [np.array(roles, np.uint8).tobytes()], [np.array(sizes, "<u4").tobytes()], [pack(codes)], [list(words)], [counts.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _NUMBERED.types, strict=True)], schema=_NUMBERED)
        number += 1


def good_turing(of: dict[int, int], k: int = K) -> np.ndarray:
    """Discount ratios d[0..k+1] from counts of counts; d[k+1] is 1. Counts too few for the rule get (r - 0.5) / r."""
    n = [0.0, *(float(of.get(r, 0)) for r in range(1, k + 2))]
    d = np.array([1.0] + [(r - 0.5) / r for r in range(1, k + 1)] + [1.0])
    if all(n[1:]):
        rest = (k + 1) * n[k + 1] / n[1]
        rule = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if rest != 1 else -1 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in rule):
            d[1 : k + 1] = rule
    return d


def _counts_of_counts(df: DataFrame, col: str = "c") -> dict[int, int]:
    return {r["r"]: r["n"] for r in df.filter(F.col(col).between(1, K + 1)).groupBy(F.col(col).cast("int").alias("r")).agg(F.count("*").alias("n")).collect()}


class Unigrams:
    """P1 as a function of the training count."""

    def __init__(self, d: np.ndarray, total: int, known_mass: float):
        self.d, self.total, self.unknown = d, total, 1.0 - known_mass

    def __call__(self, c: np.ndarray) -> np.ndarray:
        p = self.d[np.minimum(c, K + 1)] * c / max(self.total, 1)
        return np.where(c > 0, p, self.unknown)


class Keys:
    """Exact 64-bit keys of pairs of word ids, within a bucket."""

    def __init__(self, buckets: int, size: int, limit: float):
        self.none = np.uint64(size)  # after all words: what a question about a context alone has as its second word
        self.buckets, self.size, self.limit = np.uint64(buckets), np.uint64(size + 1), limit
        if 2 * (size // buckets + 1) * (size + 1) >= 1 << 64:
            raise ValueError(f"{size} words need more than {buckets} buckets")

    def make(self, h: np.ndarray, w: np.ndarray, ch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and keys; contexts that occur more often than the limit go by both words."""
        split = (ch > self.limit).astype(np.uint64)
        return (h + split * w * np.uint64(7919)) % self.buckets, (h // self.buckets * np.uint64(2) + split) * self.size + w

    def contexts(self, keys: np.ndarray) -> np.ndarray:
        """Numbers that tell apart the contexts of keys of one bucket, but for split ones."""
        return keys // self.size


def _batch_grams(row: dict, keys: Keys, places: bool):
    """The batch's distinct bigrams h, w of word places, how often they are learnt, and those of known words, or one for each known context without such a bigram, with bucket and key, sorted; at: the bigram of each token, if places are asked for."""
    codes = np.frombuffer(unpack(row["codes"]), "<u4")
    ids, c = (np.frombuffer(unpack(row[k]), "<u8") for k in ("ids", "word_counts"))
    sizes, roles = np.frombuffer(row["sizes"], "<u4").astype(np.int64), np.frombuffer(row["roles"], np.uint8)
    grams = np.zeros(len(codes), np.uint64)  # a document's first token follows the end, which the batch numbered first
    grams[1:] = codes[:-1]
    grams[np.cumsum(sizes) - sizes] = 0
    grams <<= np.uint64(32)
    grams |= codes
    learnt, times = np.unique(grams[np.repeat(roles == 0, sizes)], return_counts=True)
    pair, at = np.unique(grams, return_inverse=True) if places else (np.unique(grams), None)
    del grams
    h, w = (pair >> np.uint64(32)).astype(np.uint32), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    seen = np.zeros(len(pair), np.uint32)
    seen[np.searchsorted(pair, learnt)] = times
    del learnt, times, pair
    known = np.flatnonzero((c[h] > 0) & (c[w] > 0))
    alone = (c > 0) & (c <= keys.limit)  # statistics of larger contexts reach all batches
    alone[h[known]] = False
    rest = np.flatnonzero(alone[h])
    rest = rest[np.unique(h[rest], return_index=True)[1]]
    second = np.concatenate([ids[w[known]], np.full(len(rest), keys.none, np.uint64)])
    known = np.concatenate([known, rest])
    bucket, key = keys.make(ids[h[known]], second, c[h[known]])
    order = np.lexsort((key, bucket))
    return codes, c, sizes, roles, at, h, w, seen, known[order], bucket[order], key[order]


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


@tidied
def _send(batches: Iterator[pa.RecordBatch], keys: Keys) -> Iterator[pa.RecordBatch]:
    names, types = ["bucket", "batch", "n", "grams"], (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for row in _one_by_one(batches):
        _, c, _, _, _, h, w, seen, known, bucket, key = _batch_grams(row, keys, False)
        firsts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
        rows = []
        for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(bucket)], strict=True):
            own = known[a:b]
            split = (c[h[own]] > keys.limit).astype(np.uint8)
            rows.append((int(bucket[a]), row["batch"], b - a, pack(np.diff(key[a:b], prepend=np.uint64(0)), c[w[own]], seen[own].astype("<u4"), split)))
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 64]], t) for k, t in enumerate(types)], names=names)


@tidied
def _sum(frame: pd.DataFrame, keys: Keys, p1: Unigrams) -> pd.DataFrame:
    """One bucket: totals of its bigrams and statistics of its contexts, back to the batches."""
    sent = []
    for n, data in zip(frame["n"], frame["grams"], strict=True):
        raw = unpack(data)
        sent.append((np.cumsum(np.frombuffer(raw, "<u8", n), dtype=np.uint64), np.frombuffer(raw, "<u8", n, 8 * n), np.frombuffer(raw, "<u4", n, 16 * n), np.frombuffer(raw, np.uint8, n, 20 * n)))
    key, first, at = np.unique(np.concatenate([x[0] for x in sent]), return_index=True, return_inverse=True)
    total = np.bincount(at, np.concatenate([x[2] for x in sent]), len(key)).astype(np.int64)
    cw, split = (np.concatenate([x[k] for x in sent])[first] for k in (1, 3))
    # Statistics by context: how many bigrams of counts 1 to K, the tokens of larger counts, and the mass of P1.
    context, of = np.unique(keys.contexts(key), return_inverse=True)
    stats = np.zeros((len(context), K + 2))
    hit = total > 0
    for r in range(1, K + 1):
        stats[:, r - 1] = np.bincount(of[total == r], minlength=len(context))
    stats[:, K] = np.bincount(of[total > K], total[total > K], len(context))
    stats[:, K + 1] = np.bincount(of[hit], p1(cw[hit].astype(np.int64)), len(context))
    rows, begin = [], 0
    for (own, _, _, _), batch in zip(sent, frame["batch"], strict=True):
        places = at[begin : begin + len(own)]
        begin += len(own)
        kinds = np.unique(of[places])
        rows.append((batch, len(own), pack(total[places].astype("<u4"), stats[kinds].astype("<f8")), None, None))
    apart = np.flatnonzero(split)  # contexts of which other buckets have a part too
    bucket = int(frame["bucket"].iloc[0])
    shift = (key[apart] % keys.size) * np.uint64(7919)
    h = keys.contexts(key[apart]) // np.uint64(2) * keys.buckets + (np.uint64(bucket) + keys.buckets - shift % keys.buckets) % keys.buckets
    # One and the same number of keys.contexts() may stand for several split contexts here: they are told apart by id.
    whole, of = np.unique(h, return_inverse=True)
    t, p = total[apart], p1(cw[apart].astype(np.int64)) * (total[apart] > 0)
    part = np.stack([np.bincount(of[t == r], minlength=len(whole)).astype(float) for r in range(1, K + 1)] + [np.bincount(of[t > K], t[t > K], len(whole)), np.bincount(of, p, len(whole))], axis=1) if len(whole) else np.zeros((0, K + 2))
    counts = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
    rows.append((-1, bucket, pack(key, total.astype("<u8")), pa.array(whole.astype(np.int64)).to_pylist(), part.ravel().tolist()))
    rows.append((-2, 0, b"", counts.tolist(), None))
    return pd.DataFrame(rows, columns=["batch", "n", "data", "ids", "stats"])


class Backoff:
    """Bigram probabilities from discounts and contexts' statistics."""

    def __init__(self, d2: np.ndarray, p1: Unigrams):
        self.d2, self.p1 = d2, p1

    def context(self, stats: np.ndarray, ch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts: what to divide counts by, and alpha."""
        kept = stats[:, :K] @ (self.d2[1 : K + 1] * np.arange(1, K + 1)) + stats[:, K]
        over = np.maximum(ch, 1).astype(float)
        left = 1 - kept / over
        none = left < 1e-12
        over[none] += 1
        left = 1 - kept / over
        return over, left / np.maximum(1 - stats[:, K + 1], 1e-300)

    def seen(self, c: np.ndarray, over: np.ndarray) -> np.ndarray:
        return self.d2[np.minimum(c, K + 1)] * c / over


@tidied
def _score(coded: pd.DataFrame, back: pd.DataFrame, keys: Keys, model: Backoff, hot, base: tuple[int, int]) -> pd.DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    if not len(coded):
        return pd.DataFrame({k: [] for k in names})
    row = coded.iloc[0]
    codes, c, sizes, roles, at, h, w, _, known, bucket, key = _batch_grams(row, keys, True)
    ch = c.astype(np.int64)
    over, alpha = np.ones(len(c)), np.ones(len(c))  # of each word of the batch as a context
    total = np.zeros(len(h), np.int64)
    firsts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    answers = dict(zip(back["bucket"], zip(back["n"], back["data"], strict=True), strict=True))
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(bucket)], strict=True):
        n, data = answers[int(bucket[a])]
        if n != b - a:
            raise ValueError("a bucket answered another question")
        raw, own = unpack(data), known[a:b]
        total[own] = np.frombuffer(raw, "<u4", n)
        kinds, first = np.unique(keys.contexts(key[a:b]), return_index=True)
        stats = np.frombuffer(raw, "<f8", len(kinds) * (K + 2), 4 * n).reshape(-1, K + 2)
        word = h[own[first]]
        over[word], alpha[word] = model.context(stats, ch[word])
    ids = np.frombuffer(unpack(row["ids"]), "<u8")
    large = np.flatnonzero(ch > keys.limit)
    if len(large):
        table = hot.value
        stats = np.array([table[int(i)] for i in ids[large]])
        over[large], alpha[large] = model.context(stats, ch[large])
    p1 = model.p1(ch)
    with np.errstate(divide="ignore"):
        gram = np.where(total > 0, np.log10(model.seen(total, over[h])), np.log10(alpha[h]) + np.log10(p1[w]))
        plain = np.log10((ch + 0.5) / (base[0] + 0.5 * (base[1] + 1)))
    ends = np.cumsum(sizes)
    by_doc = lambda x: np.add.reduceat(x, ends - sizes) if len(sizes) else x
    return pd.DataFrame({"doc_id": pd.array(row["doc_ids"], "Int64"), "held_out": roles == 1, "n_tokens": sizes, "n_known": by_doc((ch[codes] > 0).astype(np.int64)), "base_score": by_doc(plain[codes]), "score": by_doc(gram[at])})


def score_documents(docs: DataFrame, role, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, batch: int = BATCH) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. role: 0 learn, 1 held out, 2 neither."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), role.cast("int").alias("role"))
    buckets = buckets or buckets_for(rows, "text", BUCKET)
    numbered = settle(rows.mapInArrow(lambda it: _number(it, batch), "batch bigint, doc_ids array<bigint>, roles binary, sizes binary, codes binary, words array<binary>, counts array<int>"), "numbered")
    words = numbered.select("batch", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "x")).select("batch", "code", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    # Dense ids: place within a partition of the stored table, after the words of earlier partitions.
    vocab = settle(words.groupBy("word").agg(F.sum("n").alias("c")).withColumn("place", F.monotonically_increasing_id()), "vocabulary")
    stored = vocab
    release(docs.sparkSession)
    part = F.shiftright("place", 33)
    sizes = {r["p"]: r["n"] for r in vocab.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row per partition
    starts, size = [], 0
    for p in sorted(sizes):
        starts.append((p, size))
        size += sizes[p]
    begin = docs.sparkSession.createDataFrame(starts, "p bigint, begin bigint")
    vocab = vocab.join(F.broadcast(begin), part == F.col("p")).select("word", "c", (F.col("begin") + F.col("place") % (1 << 33)).alias("id"))
    known = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    d1 = good_turing(_counts_of_counts(vocab))
    weights = F.element_at(F.array(*map(F.lit, d1[1:].tolist())), F.least(F.col("c"), F.lit(K + 1)).cast("int"))
    mass = vocab.filter("c > 0").agg(F.sum(weights * F.col("c"))).first()[0] or 0.0
    p1 = Unigrams(d1, known["n"], mass / max(known["n"], 1) if known["n"] else 0.0)
    if 0 < known["n"] and p1.unknown <= 0:  # no word was seen few times: one more token is unknown
        p1 = Unigrams(d1 * known["n"] / (known["n"] + 1), known["n"], known["n"] / (known["n"] + 1))
    keys = Keys(buckets, size, known["n"] / min(buckets, SPLIT))

    def number_globally(words: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({k: [] for k in ("batch", "doc_ids", "roles", "sizes", "codes", "ids", "word_counts")})
        words = words.sort_values("code")
        out = batch.copy()
        out["ids"], out["word_counts"] = [pack(words["id"].to_numpy("<u8"))], [pack(words["c"].to_numpy("<u8"))]
        return out

    back = words.join(vocab, "word").select(F.col("batch").alias("of"), "code", "id", "c")
    payload = "batch bigint, doc_ids array<bigint>, roles binary, sizes binary, codes binary"
    coded = settle(back.groupBy("of").cogroup(numbered.select("batch", "doc_ids", "roles", "sizes", "codes").groupBy("batch")).applyInPandas(number_globally, f"{payload}, ids binary, word_counts binary"), "coded")
    del words, vocab, back
    release(docs.sparkSession, numbered, stored)
    sent = coded.select("batch", "roles", "sizes", "codes", "ids", "word_counts").mapInArrow(lambda it: _send(it, keys), "bucket bigint, batch bigint, n bigint, grams binary")
    bigrams = settle(
        sent.groupBy("bucket").applyInPandas(lambda f: _sum(f, keys, p1).assign(bucket=f["bucket"].iloc[0]), "batch bigint, n bigint, data binary, ids array<bigint>, stats array<double>, bucket bigint"), "bigrams"
    )
    del sent
    release(docs.sparkSession)
    counts = [r["c"] for r in bigrams.filter("batch = -2").select(F.posexplode("ids").alias("r", "c")).groupBy("r").agg(F.sum("c").alias("c")).orderBy("r").collect()] or [0] * (K + 3)
    hot_rows = bigrams.filter("batch = -1").select(F.posexplode("ids").alias("k", "id"), "stats").select("id", *(F.col("stats")[F.col("k") * (K + 2) + i].alias(f"s{i}") for i in range(K + 2)))
    hot = sc.broadcast({r["id"]: list(r)[1:] for r in hot_rows.groupBy("id").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(K + 2))).collect()})  # fewer than SPLIT rows
    model = Backoff(good_turing(dict(enumerate(counts))), p1)
    base = (known["n"], known["v"])
    answers = bigrams.filter("batch >= 0").select(F.col("batch").alias("of"), "bucket", "n", "data")
    scored = coded.groupBy("batch").cogroup(answers.groupBy("of")).applyInPandas(lambda a, b: _score(a, b, keys, model, hot, base), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known["n"]).cast("long").alias("train_tokens"), "base_score", "score")
