"""Markdown notes as a graph: one node per note, one edge per resolved link, unresolved links kept apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import frontmatter, inline_tags, wikilinks

_FIELDS = "id string, title string, doctype string, tags array<string>, links array<string>"


def _scalar(v: str) -> str:
    return v.strip().strip("\"'").lstrip("#").strip()


def properties(block: str) -> dict[str, object]:
    """Top-level keys of a frontmatter block: scalars, flow lists and block lists."""
    out: dict[str, object] = {}
    key = None
    for line in block.splitlines():
        body = line.strip()
        if body.startswith("- ") and key is not None:
            held = out[key] if isinstance(out[key], list) else []
            out[key] = [*held, _scalar(body[2:])]
        elif ":" in line and not line.startswith((" ", "\t", "#")):
            key, _, value = line.partition(":")
            key, value = key.strip(), value.strip()
            out[key] = [x for x in map(_scalar, value[1:-1].split(",")) if x] if value.startswith("[") and value.endswith("]") else _scalar(value)
    return out


def tag_list(props: dict[str, object]) -> list[str]:
    found = []
    for key in ("tags", "tag"):
        v = props.get(key, [])
        found += v if isinstance(v, list) else [x for x in map(_scalar, v.split(",")) if x]
    return found


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, text in zip(f["path"], f["text"], strict=True):
            block, body = frontmatter(text or "")
            props = properties(block or "")
            local = path.removesuffix(".md")
            tags = list(dict.fromkeys([*tag_list(props), *inline_tags(body)]))
            rows.append((local, props.get("title") or local.rsplit("/", 1)[-1], props.get("doctype"), tags, wikilinks(body)))
        yield pd.DataFrame(rows, columns=["id", "title", "doctype", "tags", "links"])


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """notes(path, text) of the Markdown files below a folder, without hidden folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    rows = files.select(F.expr("substring_index(path, ':', -1)").alias("path"), F.decode("content", "UTF-8").alias("text"))
    return rows.filter(~F.col("path").rlike(r"/\.[^/]"))


def extract(notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(id, title, doctype, tags), edges(src, dst), unresolved(src, link) of notes(path, text).

    A link is resolved by id, else by title; of notes with one title the first by id is meant.
    """
    nodes = notes.select("path", "text").mapInPandas(_parse, _FIELDS)
    links = nodes.select(F.col("id").alias("src"), F.explode("links").alias("link"))
    titles = nodes.groupBy("title").agg(F.min("id").alias("by_title"))
    found = (
        links.join(nodes.select(F.col("id").alias("by_id")), F.col("link") == F.col("by_id"), "left")
        .join(titles, F.col("link") == F.col("title"), "left")
        .withColumn("dst", F.coalesce("by_id", "by_title"))
    )
    return nodes.drop("links"), found.filter("dst is not null").select("src", "dst"), found.filter("dst is null").select("src", "link")


def renamed(df: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """Ids of one namespace moved to another."""
    return df.withColumns({c: F.when(F.startswith(F.col(c), F.lit(old)), F.concat(F.lit(new), F.substring(F.col(c), len(old) + 1, 1 << 30))).otherwise(F.col(c)) for c in columns})


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")
