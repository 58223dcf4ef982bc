"""Full-text search: an index of terms with positions as tables, a query parser, and BM25 ranking by joins.

Text fields are split into lower-cased words and, if asked, stemmed; keyword fields are one exact term per value. An index
is made once: store() writes it by term, so a query reads the postings of its own words only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Parts that stored postings are kept in, by the hash of the term.
SHARDS = 64
#: Words that a task groups at a time.
TOKENS = 1 << 18


@dataclass(frozen=True)
class Index:
    """postings(field, term, idx, tf, places, len) and stats(field, n, avg): documents with the field, and their mean length."""

    postings: DataFrame
    stats: DataFrame
    fields: dict[str, float]
    stemmed: frozenset[str] = frozenset()

    @property
    def lengths(self) -> DataFrame:
        return self.postings.select("field", "idx", "len").distinct()


#: English endings, longest first in each group, with what takes their place and the least number of letters before them.
ENDINGS = (
    (("sses", "ss", 1), ("ies", "i", 1), ("ss", "ss", 0), ("us", "us", 0), ("s", "", 2)),
    (("eed", "ee", 2), ("ingly", "", 3), ("edly", "", 3), ("ing", "", 3), ("ed", "", 3)),
    (("ational", "ate", 2), ("ization", "ize", 2), ("fulness", "ful", 2), ("ousness", "ous", 2), ("iveness", "ive", 2), ("tional", "tion", 2), ("ation", "ate", 2), ("ator", "ate", 2), ("alism", "al", 2), ("aliti", "al", 2), ("ousli", "ous", 2), ("entli", "ent", 2), ("li", "", 3)),
    (("icate", "ic", 2), ("ative", "", 2), ("alize", "al", 2), ("ical", "ic", 2), ("ness", "", 3), ("ful", "", 3)),
)


def stem(word: Column) -> Column:
    """An English word without its endings, by groups of suffix rules in turn; a final y after a consonant is i. Two forms of a word share a stem."""

    def shortened(k: int, now: Column) -> Column:
        changed = None
        for end, to, before in ENDINGS[k]:
            fits = F.endswith(now, F.lit(end)) & (F.length(now) >= len(end) + before)
            cut = F.concat(F.left(now, F.length(now) - len(end)), F.lit(to))
            if k == 1 and not to:  # only behind a vowel
                fits = fits & F.left(now, F.length(now) - len(end)).rlike("[aeiouy]")
                cut = F.regexp_replace(F.regexp_replace(cut, "([bdfgmnprt])\\1$", "$1"), "(at|bl|iz)$", "$1e")  # hopping: hop, sized: size
            changed = F.when(fits, cut) if changed is None else changed.when(fits, cut)
        return changed.otherwise(now)

    def by_group(k: int):
        return lambda x: shortened(k, x)

    step = F.array(word)  # each step is a column of its own, bound once
    for k in range(len(ENDINGS)):
        step = F.transform(step, by_group(k))
        if k == 1:
            step = F.transform(step, lambda x: F.regexp_replace(x, "(?<=.[^aeiou])y$", "i"))
    step = F.transform(step, lambda x: F.regexp_replace(x, "(?<=.{3})e$", ""))
    return F.when(F.length(word) <= 2, word).otherwise(step[0])


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def _coded(batches):
    """One row per TOKENS words of documents(field, idx, words): the distinct words, and each document's words by their places among these."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:  # one document at least
            held = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, held + TOKENS, "right")), start + 1)
            part = batch.slice(start, stop - start)
            coded = part.column("words").flatten().dictionary_encode()
            lens = np.diff(ends[start:stop], prepend=held).astype(np.int32)
            if len(coded):
                row = {"words": coded.dictionary, "codes": pc.fill_null(coded.indices, -1), "idx": part.column("idx"), "lens": pa.array(lens)}
                yield pa.RecordBatch.from_pydict({"field": part.column("field")[:1]} | {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in row.items()})
            start = stop


def _postings(batches):
    """The postings of each row of coded documents, whose words may have become stems; a list of places is in ascending order."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for r in range(batch.num_rows):
            words = batch.column("words")[r].values.dictionary_encode()
            codes, lens = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("codes", "lens"))
            doc, start = np.repeat(np.arange(len(lens)), lens), np.cumsum(lens, dtype=np.int64) - lens
            known = np.flatnonzero(codes >= 0)
            doc, at = doc[known], (known - np.repeat(start, lens)[known]).astype(np.int32)
            key = doc * len(words.dictionary) + words.indices.to_numpy()[codes[known]]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            offsets = np.append(first, len(key))
            doc, term = np.divmod(key[first], max(len(words.dictionary), 1))
            for a in range(0, len(first), 1 << 16):
                z = min(a + (1 << 16), len(first))
                places = pa.ListArray.from_arrays(pa.array((offsets[a : z + 1] - offsets[a]).astype(np.int32)), pa.array(at[order[offsets[a] : offsets[z]]]))
                found = {"term": words.dictionary.take(pa.array(term[a:z])), "idx": batch.column("idx")[r].values.take(pa.array(doc[a:z])), "len": pa.array(lens[doc[a:z]]), "tf": pa.array(np.diff(offsets[a : z + 1])), "places": places}
                yield pa.RecordBatch.from_pydict({"field": pa.array([batch.column("field")[r].as_py()] * (z - a), pa.string())} | found)


def build(docs: DataFrame, texts: dict[str, float], keywords: dict[str, float] | None = None, idx: str = "idx", stemming: bool = False) -> Index:
    """An index of docs, one document in a row. Words become postings where their document is, without a shuffle; each distinct word of a batch is stemmed once."""
    kinds, keywords, rows = dict(docs.dtypes), keywords or {}, None
    for name in [*texts, *keywords]:
        if name in texts:
            found = words(F.col(name))
        else:
            found = F.col(name) if kinds[name].startswith("array") else F.array(F.col(name).cast("string"))
        each = docs.select(F.lit(name).alias("field"), F.col(idx).cast("long").alias("idx"), found.cast("array<string>").alias("words"))
        if name in texts and stemming:
            each = each.mapInArrow(_coded, "field string, words array<string>, codes array<int>, idx array<bigint>, lens array<int>").withColumn("words", F.transform("words", stem))
        made = _postings if name in texts and stemming else lambda batches: _postings(_coded(batches))
        part = each.mapInArrow(made, "field string, term string, idx bigint, len int, tf bigint, places array<int>")
        rows = part if rows is None else rows.unionByName(part)
    stats = None
    for name in [*texts, *keywords]:  # a document counts once it has a term
        size = F.size(words(F.col(name))) if name in texts else (F.size(name) if kinds[name].startswith("array") else F.when(F.col(name).isNotNull(), 1).otherwise(0))
        own = docs.select(size.alias("len")).filter("len > 0").agg(F.count("*").alias("n"), F.avg("len").alias("avg")).select(F.lit(name).alias("field"), "n", "avg")
        stats = own if stats is None else stats.unionAll(own)
    return Index(rows, stats, texts | keywords, frozenset(texts) if stemming else frozenset())


def store(index: Index, folder: str) -> Index:
    """Write the postings by shard and term, each task its own files, and the statistics; give the index that reads them."""
    spark = index.postings.sparkSession
    shard = F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int")
    rows = index.postings.withColumn("shard", shard)
    most, was = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set(most, "8m")  # what a task hands over at a time
    try:
        rows.sortWithinPartitions("shard", "term", "field", "idx").write.partitionBy("shard").mode("overwrite").option("compression", "zstd").parquet(f"{folder}/postings")
    finally:
        spark.conf.set(most, was)
    index.stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    return open_index(spark, folder, index.fields, index.stemmed)


def open_index(spark: SparkSession, folder: str, fields: dict[str, float], stemmed: frozenset[str] = frozenset()) -> Index:
    schema = "field string, term string, idx bigint, len int, tf bigint, places array<int>, shard int"
    return Index(spark.read.schema(schema).parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/stats"), fields, stemmed)


@dataclass(frozen=True)
class Clause:
    """Words that must follow each other in a field (any searchable one if None); must: needed, may: one of a group of such, not: refused."""

    field: str | None
    words: tuple[str, ...]
    kind: str = "must"
    group: int = 0


_TOKEN = re.compile(r'(-|\+)?(?:(\w+):)?(?:"([^"]*)"|(\S+))')


def clauses(query: str, fields) -> list[Clause]:
    """All clauses must match but those joined by OR, of which one must, and those led by NOT or a minus, which must not. A field that is unknown is an error."""
    out: list[Clause] = []
    refuse = join = False
    group = 0
    for m in _TOKEN.finditer(query):
        sign, name, phrase, word = m.groups()
        if phrase is None and name is None and word in ("AND", "OR", "NOT"):
            refuse, join = refuse or word == "NOT", join or word == "OR"
            continue
        if name is not None and name not in fields:
            raise ValueError(f"unknown field {name}")
        text = phrase if phrase is not None else word
        if name is None and phrase is None and ":" in word and not word.startswith(":"):
            raise ValueError(f"unknown field {word.split(':')[0]}")
        kind = "not" if refuse or sign == "-" else "must"
        if join and kind == "must" and out and out[-1].kind != "not":
            last = out[-1]
            if last.kind == "must":
                group += 1
                out[-1] = last = Clause(last.field, last.words, "may", group)
            out.append(Clause(name, (text,), "may", last.group))
        else:
            out.append(Clause(name, (text,), kind))
        refuse = join = False
    return out


def _matched(index: Index, query: str, texts) -> tuple[DataFrame, list[Clause]]:
    """clause, field, idx, score of each clause's matches; phrases match where all their words follow each other."""
    spark = index.postings.sparkSession
    asked, found = [], clauses(query, index.fields)
    for k, c in enumerate(found):
        for f, boost in index.fields.items():
            if c.field in (None, f):
                parts = [w for w in re.split(r"[^\w]+|_", c.words[0].lower()) if w] if f in texts else [c.words[0]]
                asked += [(k, f, w, i, len(parts), float(boost)) for i, w in enumerate(parts)]
    want = spark.createDataFrame(asked or [(-1, "", "", 0, 1, 0.0)], "clause int, field string, term string, nth int, parts int, boost double")
    if index.stemmed:
        want = want.withColumn("term", F.when(F.col("field").isin(*index.stemmed), stem(F.col("term"))).otherwise(F.col("term")))
    terms = sorted({r["term"] for r in want.select("term").distinct().collect()})  # the query's words
    postings = index.postings.filter(F.col("term").isin(terms))
    if "shard" in index.postings.columns:
        shards = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int")).distinct().collect()]
        postings = postings.filter(F.col("shard").isin(shards))
    hits = postings.join(F.broadcast(want), ["field", "term"])
    df = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    rated = hits.join(F.broadcast(index.stats), "field").join(F.broadcast(df), ["field", "term"])  # a row per field, and per word of the query
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    start = F.transform("places", lambda p: p - F.col("nth"))
    by = rated.groupBy("clause", "field", "idx", "parts").agg(F.sum(F.col("boost") * idf * tf).alias("score"), F.countDistinct("nth").alias("met"), F.collect_list(start).alias("starts"))
    run = F.aggregate(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.col("starts")[0], lambda a, b: F.array_intersect(a, b))
    return by.filter(F.col("met") == F.col("parts")).filter((F.col("parts") == 1) | (F.size(run) > 0)).select("clause", "idx", "score"), found


def score(index: Index, query: str, texts) -> DataFrame:
    """idx, score of the documents that match the query; blank queries, and such as only refuse, match none."""
    hits, found = _matched(index, query, texts)
    needed = sum(c.kind == "must" for c in found) + len({c.group for c in found if c.kind == "may"})
    kinds = index.postings.sparkSession.createDataFrame(
        [(k, -1 if c.kind == "not" else c.group * 1000 if c.kind == "may" else k + 1_000_000) for k, c in enumerate(found)] or [(-1, -1)], "clause int, part int"
    )
    rows = hits.join(F.broadcast(kinds), "clause")
    sums = rows.groupBy("idx").agg(F.sum("score").alias("score"), F.countDistinct("part").alias("met"), F.min("part").alias("low"))
    return sums.filter((F.col("low") >= 0) & (F.col("met") == max(needed, 1))).select("idx", "score")


def rank(index: Index, query: str, texts, k: int = 50) -> DataFrame:
    return score(index, query, texts).orderBy(F.desc("score"), "idx").limit(min(k, 5000))


def rank_with_total(index: Index, query: str, texts, k: int = 50) -> DataFrame:
    """The k best with, in each row, how many documents match."""
    found = score(index, query, texts)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("score"), "idx").limit(min(k, 5000)).crossJoin(F.broadcast(total))  # one row
