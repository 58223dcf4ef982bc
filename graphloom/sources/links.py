"""Links between records: URL keys and their resolution, links in pages, edge rules over JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def url_keys(url: Column) -> Column:
    """The keys that a URL is known by, in order: itself without its fragment, pageId values, its last two segments, space and title of a wiki page, a ticket's key."""
    whole = F.trim(F.split_part(url, F.lit("#"), F.lit(1)))
    pages = F.filter(F.regexp_extract_all(F.regexp_extract(whole, r"\?(.*)$", 1), F.lit(r"(?:^|&)pageId=([^&]*)"), 1), lambda x: x != "")
    path = F.split_part(F.regexp_extract(whole, r"://(.*)$", 1), F.lit("?"), F.lit(1))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    tail = F.when(n >= 2, F.concat_ws("/", at(-2), at(-1)))
    # The host is the first segment; a path may also be given behind an empty host.
    wiki = F.when((n >= 6) & (at(1) == "wiki") & (at(2) == "spaces") & (at(4) == "pages"), F.concat_ws("/", at(3), F.array_join(F.slice(parts, F.lit(6), n), "/")))
    ticket = F.when((n >= 2) & (at(-2) == "browse"), at(-1))
    return F.filter(F.concat(F.array(whole), pages, F.array(tail, wiki, ticket)), lambda x: x.isNotNull() & (x != ""))


def url_index(pages: DataFrame, idx: str = "idx", url: str = "url") -> DataFrame:
    """key, idx: the first page by idx that is known by a key."""
    return pages.select(F.col(idx).alias("idx"), F.explode(F.array_distinct(url_keys(F.col(url)))).alias("key")).groupBy("key").agg(F.min("idx").alias("idx"))


def resolve(links: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) and unresolved (src, url) of links(src, url): the first key that some page has decides."""
    keyed = links.select("src", "url").distinct().select("src", "url", F.posexplode_outer(url_keys(F.col("url"))).alias("place", "key"))
    found = keyed.join(index, "key", "left").groupBy("src", "url").agg(F.min_by("idx", F.when(F.col("idx").isNotNull(), F.col("place"))).alias("dst"))
    return found.filter("dst is not null").select("src", "dst").distinct(), found.filter("dst is null").select("src", "url")


def hrefs(html: Column) -> Column:
    """Targets of double-quoted href attributes, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)


def edge_rule(records: DataFrame, values: Column, targets: DataFrame, by: str = "id") -> tuple[DataFrame, DataFrame]:
    """(src, dst) and unresolved (src, value) of the array of values of records(id, ...) among targets(id, title).

    By id, or by title: the exact one, else the one equal but for case; of equal titles the first id is meant. A pair of
    nodes is linked once, whatever the direction; self references are dropped.
    """
    asked = records.select(F.col("id").alias("src"), F.explode(values).alias("value")).filter("value is not null")
    if by == "id":
        found = asked.join(targets.select(F.col("id").alias("dst"), F.col("id").alias("value")), "value", "left")
    else:
        exact = targets.groupBy(F.col("title").alias("value")).agg(F.min("id").alias("exact"))
        folded = targets.groupBy(F.lower("title").alias("low")).agg(F.min("id").alias("folded"))
        found = asked.join(exact, "value", "left").withColumn("low", F.lower("value")).join(folded, "low", "left").withColumn("dst", F.coalesce("exact", "folded"))
    return unordered(found.filter("dst is not null").select("src", "dst")), found.filter("dst is null").select("src", "value").distinct()


def unordered(edges: DataFrame) -> DataFrame:
    """Edges without self loops, each pair once, in the direction of the lesser (src, dst)."""
    kept = edges.filter("src <> dst")
    return kept.groupBy(F.least("src", "dst").alias("_u"), F.greatest("src", "dst").alias("_v")).agg(F.min(F.struct("src", "dst")).alias("e")).select("e.src", "e.dst")


def edge_list(edges: DataFrame, known: DataFrame, kinds: list[str], dedupe: str = "unordered") -> DataFrame:
    """Edges(src, dst, kind) of allowed kinds with both ends among known(id), without self loops; dedupe none, ordered or unordered."""
    kept = edges.filter(F.col("kind").isin(kinds)).filter("src <> dst").select("src", "dst")
    for end in ("src", "dst"):
        kept = kept.join(known.select(F.col("id").alias(end)), end, "left_semi")
    kept = kept.select("src", "dst")
    return {"none": lambda: kept, "ordered": kept.distinct, "unordered": lambda: unordered(kept)}[dedupe]()
