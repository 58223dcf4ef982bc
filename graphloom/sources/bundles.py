"""Concept bundles (Markdown files with typed frontmatter) and line records as graphs."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_list, frontmatter, sorted_unique
from .links import resolve, url_index
from .notes import properties, tag_list

#: States of a concept, the first being the default, and files that are no concepts.
STATES = ("stable", "draft", "deprecated")
SKIPPED = ("index.md", "log.md")

_LINK = re.compile(r"(?<!!)\[(?!!\[[^\]]*\]\([^)]*\)\])[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)")
_FIELDS = "id string, title string, type string, status string, tags array<string>, source_url string, verified array<string>, links array<string>, problem string"


def relative(path: str, link: str) -> str | None:
    """The concept that a link in a file means: relative to its folder, or to the root after a slash; null outside the bundle or if it is no .md file."""
    target = unquote(link.split("#")[0].split("?")[0])
    if not target.endswith(".md") or "://" in target:
        return None
    full = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(path), target))
    return None if full.startswith("..") else full.removesuffix(".md")


def _concept(path: str, text: str) -> tuple:
    block, body = frontmatter(text)
    props = properties(block or "")
    kind, status, problem = props.get("type"), props.get("status") or STATES[0], None
    if block is None:
        problem = "no frontmatter"
    elif not isinstance(kind, str) or not kind:
        problem = "no type"
    elif status not in STATES:
        problem = "unknown status"
    elif "tags" in props and not isinstance(props["tags"], list):
        problem = "tags are no list"
    local = path.removesuffix(".md")
    verified = props.get("verified", [])
    links = _LINK.findall(f"{props.get('description', '')}\n{body}")
    return (
        local, props.get("title") or posixpath.basename(local), kind if isinstance(kind, str) else None, str(status), sorted(set(tag_list(props))),
        props.get("source_url") or None, sorted(set(verified if isinstance(verified, list) else [verified])), [relative(path, x) or x for x in links], problem,
    )


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    for f in frames:
        yield pd.DataFrame([_concept(p, t or "") for p, t in zip(f["path"], f["text"], strict=True)], columns=names)


def concepts(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, edges(src, dst), unresolved(src, link), rejected(id, problem) of files(path, text).

    A link means a file of the bundle by its path, or by URL the first concept whose source_url shares a key with it.
    """
    kept = files.filter(~F.substring_index("path", "/", -1).isin(*SKIPPED)).select("path", "text")
    rows = kept.mapInPandas(_parse, _FIELDS)
    good = rows.filter("problem is null").drop("problem")
    nodes = good.drop("links").withColumn("trust", trust("verified"))
    asked = good.select(F.col("id").alias("src"), F.explode(F.array_distinct("links")).alias("link"))
    by_path = asked.join(nodes.select(F.col("id").alias("dst")), F.col("link") == F.col("dst"), "left")
    web = by_path.filter(F.col("dst").isNull() & F.contains("link", F.lit("://"))).select("src", F.col("link").alias("url"))
    by_url, lost = resolve(web, url_index(nodes.filter("source_url is not null"), "id", "source_url"))
    edges = by_path.filter("dst is not null").select("src", "dst").unionByName(by_url).filter("src <> dst").distinct()
    unresolved = by_path.filter(F.col("dst").isNull() & ~F.contains("link", F.lit("://"))).select("src", "link").unionAll(lost)
    return nodes, edges, unresolved, rows.filter("problem is not null").select("id", "problem")


def trust(verified: str) -> Column:
    """human-reviewed if a person verified it, machine-confirmed if anything did, else unverified."""
    human = F.exists(verified, lambda x: F.startswith(x, F.lit("human:")))
    return F.when(human, "human-reviewed").when(F.size(verified) > 0, "machine-confirmed").otherwise("unverified")


def records(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, edges, unresolved edges and rejected lines of `N|id|title|kind|tags|k=v;k=v` and `E|source|target` lines.

    Blank lines are passed over; a line of another form is rejected; a repeated id is rejected as often as it appears.
    """
    x = F.col(col)
    parts, filled = F.split(x, r"\|"), lines.filter(F.trim(col) != "")
    is_node = x.rlike(r"^N\|[^|]+\|[^|]*\|[^|]*\|[^|]*\|([^|=;]+=[^|;]*(;[^|=;]+=[^|;]*)*)?$")
    is_edge = x.rlike(r"^E\|[^|]+\|[^|]+$")
    at = lambda i: F.element_at(parts, i)
    props = F.when(at(6) != "", F.map_from_entries(F.transform(F.split(at(6), ";"), lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_extract(p, "=(.*)$", 1))))).otherwise(F.create_map().cast("map<string,string>"))
    all_nodes = filled.filter(is_node).select(at(2).alias("id"), at(3).alias("title"), at(4).alias("kind"), sorted_unique(csv_list(at(5))).alias("tags"), props.alias("properties"), x.alias("line"))
    once = all_nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1").select("id")
    nodes = all_nodes.join(once, "id", "left_semi")
    edges = filled.filter(is_edge).select(at(2).alias("src"), at(3).alias("dst")).distinct()
    known = lambda name: nodes.select(F.col("id").alias(name))
    whole = edges.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi").select("src", "dst")
    rejected = filled.filter(~(is_node | is_edge)).select(x.alias("line")).unionAll(all_nodes.join(once, "id", "left_anti").select("line"))
    return nodes.drop("line"), whole, edges.join(whole, ["src", "dst"], "left_anti"), rejected
