"""Document fingerprints from closed syncmers, in DataFrame functions only.

Symbols are words. Scripts written without spaces give a symbol per code point, and longer runs of other characters are
cut after the characters of CUT; both depend on the run's own content only, so something put in front of it shifts
nothing. A k-mer of five symbols is an anchor if the least hash of its inner pairs (s-mers of two) lies at its first or
last pair: that depends on the k-mer alone, so an edit changes only the anchors that overlap it, and of any three k-mers
in a row one is an anchor.

A fingerprint is the list of all anchors of the text in order: of each, 62 bits of its hash and, in the last two, how
many symbols it lies behind the anchor before it (1 to 3; the first: behind the beginning). Places in the text are sums
of these steps. Likeness is positional: an anchor of one text is matched by one of the other with the same hash and the
same step, and likeness is the share of matched ones among all distinct ones of both.

Defined cases: null text counts as empty; a text of one to four symbols has one anchor, the hash of them all; a text
without symbols has an empty fingerprint, alike to another empty one (1) and to no other (0); the next document of
rows equal in doc_id and text is the next different one, and their own if there is no other; a null doc_id comes
first; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, text_or_empty

K, S = 5, 2
SPACE = "[\\x20\\x09-\\x0D]+"
#: Scripts without spaces between words; runs from this length on are cut after these characters.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
RUN, CUT = 25, "[aeimquyAEIMQUY0369/.,;:&?=_+-]"
#: Bytes of text of a part, and the most parts.
PART, PARTS = 6 << 20, 20_000


def _symbols(text: str) -> Column:
    """The symbols of a text column, as an array."""
    apart = F.when(F.rlike(text, F.lit(UNSPACED)), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(F.col(text))
    words = lambda x: F.split(F.btrim(x, F.lit(" \t\n\x0b\x0c\r")), SPACE)
    cut = F.flatten(F.transform(words(apart), lambda w: F.when(F.length(w) >= RUN, F.filter(F.split(w, f"(?<={CUT})"), lambda x: x != "")).otherwise(F.array(w))))
    found = F.when(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]{%d}" % RUN)), cut).otherwise(words(apart))
    return F.when(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), found).otherwise(F.expr("cast(array() as array<string>)"))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add all anchors of a text column in order: hash and step, 64 bits each."""
    df = df.withColumn("_h", F.transform(_symbols(text), lambda w: F.xxhash64(w)))
    df = df.withColumn("_s", F.expr(f"transform(sequence(1, greatest(size(_h) - {S - 1}, 1)), i -> xxhash64(get(_h, i - 1), get(_h, i)))"))
    inner = K - S + 1
    df = df.withColumn("_c", F.expr(
        f"transform(sequence(1, greatest(size(_h) - {K - 1}, 1)), i -> "
        f"if(array_min(slice(_s, i, {inner})) in (get(_s, i - 1), get(_s, i + {inner - 2})), xxhash64(slice(_h, i, {K})), null))"
    ))
    steps = F.expr(
        "filter(transform(_c, (x, i) -> if(x is null, null, (x & -4L) | "
        "if(i = 0 or get(_c, i - 1) is not null, 1L, if(i = 1 or get(_c, i - 2) is not null, 2L, 3L)))), x -> x is not null)"
    )
    few = F.array(F.xxhash64("_h").bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(1).cast("long")))
    return df.withColumn(out, F.when(F.size("_h") >= K, steps).when(F.size("_h") > 0, few).otherwise(F.expr("cast(array() as array<bigint>)"))).drop("_h", "_s", "_c")


def digest(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both).cast("double")


def _parts(rows: DataFrame) -> tuple[list[int], DataFrame]:
    """Bounds that cut doc_ids into parts, and the first row of each part (doc_id, hash) with the part before it, around the end."""
    n = min(PARTS, buckets_for(rows, "text", PART))
    ids = rows.select("doc_id").repartitionByRange(n, "doc_id")
    lows = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low")).collect()  # a row per part
    bounds = sorted({r["low"] for r in lows if r["low"] is not None})[1:]
    firsts = sorted((r["part"], r["first"]) for r in rows.groupBy(_part_of(bounds).alias("part")).agg(F.min(F.struct("doc_id", "hash")).alias("first")).collect())  # the same
    heads = [(x["doc_id"], x["hash"], firsts[k - 1][0]) for k, (_, x) in enumerate(firsts)]
    return bounds, rows.sparkSession.createDataFrame(heads, "h_doc_id bigint, h_hash bigint, to_part int")


def _part_of(bounds: list[int]) -> Column:
    """How many bounds are at most doc_id: first by steps of the root of their number, then within one step."""
    step = max(1, math.isqrt(len(bounds)))
    own, coarse = (F.expr(f"cast(split('{','.join(map(str, x))}', ',') as array<bigint>)") for x in (bounds, bounds[::step]))
    below = lambda array: F.size(F.filter(array, lambda b: b <= F.col("doc_id")))
    if not bounds:
        return F.lit(0)
    before = F.greatest(below(coarse) - 1, F.lit(0)) * step
    return (before + below(F.slice(own, before + 1, F.lit(step)))).cast("int")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts move once, to the part of their doc_id; the first row of a part goes to the part before it too, so that each row
    finds the next one within its part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    bounds, heads = _parts(rows)
    is_head = F.col("doc_id").eqNullSafe(F.col("h_doc_id")) & (F.col("hash") == F.col("h_hash"))
    placed = rows.withColumn("own", _part_of(bounds)).join(F.broadcast(heads), is_head, "left")  # heads: a row per part
    place = lambda part, tail: F.struct(F.col(part).alias("part"), F.lit(tail).alias("tail"))
    places = F.when(F.col("to_part").isNull(), F.array(place("own", False))).otherwise(F.array(place("own", False), place("to_part", True)))
    dealt = placed.select("doc_id", "text", "hash", F.inline(places)).repartition(max(1, len(bounds) // 4 + 1), "part")
    marked = with_anchors(dealt, "text", "hashes")
    # Backwards, the next document is the last one so far with another key.
    back = Window.partitionBy("part").orderBy(F.desc("tail"), F.desc("doc_id"), F.desc("hash"))
    before = F.lag(F.struct("doc_id", "hash", "text", "hashes")).over(back)
    marked = marked.withColumn("_b", before)
    other = ~(F.col("_b.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_b.hash") == F.col("hash")))
    marked = marked.withColumn("_b", F.when(other, F.col("_b")))
    following = F.last("_b", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = marked.withColumn("_n", following).filter("not tail").select(
        "doc_id", "hashes", F.length("text").cast("long").alias("n_chars"), F.coalesce("_n.text", "text").alias("next_text"), F.coalesce("_n.hashes", "hashes").alias("next_hashes"), "text",
    )
    half = F.floor(F.col("n_chars") / 2)
    both = both.withColumn("edited", F.concat(F.left("text", F.col("n_chars") - half), F.left("next_text", half))).drop("text", "next_text")
    both = with_anchors(both, "edited", "edited_hashes")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        digest(F.col("hashes")).alias("fingerprint"), digest(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
