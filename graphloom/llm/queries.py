"""The queries of the corpus operators over the tables of a folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, katz, langid, ngram_join, packing, rangecoder, secrets, warc
from .common import table


def op1_mixing_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rangecoder.token_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return katz.score_documents(docs, F.when(fold == 1, 1).when(fold.isNull(), 2).otherwise(0))


def op3_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return packing.assign(digests)


def op5_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_roundtrip(table(spark, sf_dir, "pages"))


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = langid.identify(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x.rank < sum(r.base for r in secrets.RULES))
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *(count(r.kind) for r in secrets.RULES if r.base), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans")
    )


def op9_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode_documents(encoded, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_seekable_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
            q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
            r AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM q)
            SELECT page_id, n AS payload_bytes, d AS payload_digest,
                   CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN first <> page_id THEN first END AS refers_to FROM r""",
        "op9_chunk_recipe_dedup": """
            WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY x)""",
    }
