"""Corpus preparation: language ID, exact dedup, near dedup, secret redaction, packing.

Each stage takes what the one before kept, written as Parquet and read again; all but the last return the columns of
`documents`. Stages drop documents without letters (language ID), all but one of equal texts, all but one of each
group of near copies; secrets are replaced by a mark; the last stage gives token pieces with their place in sequences.

Defined cases are those of the operators; of repeated rows with the same doc_id and text one stays. Rows are told apart
by 64-bit hashes of doc_id and text, so different texts that share a doc_id, or have none, are different documents; a
row without a doc_id stays only where its group has no other, and of rows that share one the hash decides. Two groups
could be taken for one by chance of about n^2 / 2^65 in n rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, langid, ngram_join, packing, secrets
from graphloom.llm.common import settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL expresses the automata, the trie or the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language stay; null, empty and letterless texts go."""
    sample = langid.fit_sample(docs.filter(langid.fold() != 2).select("lang", "text"))
    return langid.predict(docs, sample, COLUMNS).filter("lang_pred <> 'und'").select(*COLUMNS)


def _named(docs: DataFrame) -> DataFrame:
    """docs with a hash of doc_id and text: doc_id may be null, or shared by different texts."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def _only(rows: DataFrame, groups: DataFrame, choice) -> DataFrame:
    """Of each group (row, of) the row that choice, an aggregate of struct(..., row), takes."""
    ids = rows.select("row", "doc_id").distinct()
    kept = groups.distinct().join(ids, "row").groupBy("of").agg(choice.alias("best")).select("best.row")
    one = Window.partitionBy("row", "doc_id", "text").orderBy("lang", "source", "n_chars")
    return rows.join(kept, "row", "left_semi").withColumn("_r", F.row_number().over(one)).filter("_r = 1").select(*COLUMNS)


def equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the document with the largest doc_id stays."""
    rows = _named(docs)
    groups = exact_dedup.exact_dedup(rows, "row").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("of"))
    return _only(rows, groups, F.max(F.struct("doc_id", "row")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the one with the smallest doc_id stays."""
    rows = _named(docs)
    groups = ngram_join.ngram_components(rows, "row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("of"))
    return _only(rows, groups, F.min(F.struct(F.isnull("doc_id"), "doc_id", "row")))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each stretch of secrets becomes [SECRET]."""
    found = secrets.scan(docs, carry=("lang", "source")).select("doc_id", secrets.redact(F.col("text"), F.col("found")).alias("text"), "lang", "source")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with sequence_id and offset."""
    import public_tokenizers

    pieces = packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.assign(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth"))


STAGES = [
    ("language ID", language),
    ("exact dedup", equal_texts),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
