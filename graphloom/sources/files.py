"""Graph files: CSV, JSON, DOT and edge pairs in, Parquet, JSON lines and binary rows out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.tables import settle


def read_csv(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """("edges" or "nodes", rows): the header decides, further columns are kept as text."""
    rows = spark.read.option("header", True).csv(path)
    names = {c.lower() for c in rows.columns}
    return ("edges" if {"source", "target"} <= names else "nodes"), rows


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of {nodes: [...], edges: [...]} files."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.inline("nodes")), rows.select(F.inline("edges"))


_NODE = re.compile(r'^\s*"?([\w.-]+)"?\s*(?:\[(.*)\])?;?\s*$')
_EDGE = re.compile(r'^\s*"?([\w.-]+)"?\s*(->|--)\s*"?([\w.-]+)"?\s*(?:\[(.*)\])?;?\s*$')


def _dot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for line in f["value"]:
            if m := _EDGE.match(line):
                rows.append(("edge", m[1], m[3], m[4]))
            elif (m := _NODE.match(line)) and m[1] not in ("graph", "digraph", "node", "edge"):
                rows.append(("node", m[1], None, m[2]))
        yield pd.DataFrame(rows, columns=["kind", "id", "dst", "attributes"])


def read_dot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.text(path).mapInPandas(_dot, "kind string, id string, dst string, attributes string")
    return rows.filter("kind = 'node'").select("id", "attributes"), rows.filter("kind = 'edge'").select(F.col("id").alias("src"), "dst", "attributes")


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for data in f["content"]:
            x = np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64)
            yield pd.DataFrame({"src": x[:, 0], "dst": x[:, 1]})


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Edges of files of little-endian unsigned 32-bit pairs."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_pairs, "src bigint, dst bigint")


def _csr(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for data in f["content"]:
            n, m = np.frombuffer(data, "<u4", 2).tolist()
            if len(data) != 4 * (2 + n + 1 + m):
                raise ValueError("a CSR file of another length than its header says")
            offsets = np.frombuffer(data, "<u4", n + 1, 8).astype(np.int64)
            yield pd.DataFrame({"src": np.repeat(np.arange(n), np.diff(offsets)), "dst": np.frombuffer(data, "<u4", m, 8 + 4 * (n + 1)).astype(np.int64)})


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_csr, "src bigint, dst bigint")


def csr_bytes(n: int, edges: list[tuple[int, int]]) -> bytes:
    """The binary form of an adjacency that fits a driver."""
    rows = sorted(edges)
    offsets = np.searchsorted(np.array([a for a, _ in rows], np.int64), np.arange(n + 1))
    return b"".join(x.astype("<u4").tobytes() for x in (np.array([n, len(rows)]), offsets, np.array([b for _, b in rows], np.int64)))


def csr_rows(g: Graph) -> DataFrame:
    """idx, start, targets: the symmetric adjacency without self loops, parallel edges kept, as rows of a CSR matrix in index order."""
    lists = g.adjacency().groupBy(F.col("src").alias("idx")).agg(F.array_sort(F.collect_list("dst")).alias("targets"))
    rows = settle(g.nodes.select("idx").join(lists, "idx", "left").select("idx", F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets")), "csr")
    # Starts by blocks of indices: only block sums are added up in one place.
    block = F.floor(F.col("idx") / 65536)
    sums = rows.groupBy(block.alias("block")).agg(F.sum(F.size("targets")).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("block", block).withColumn("inner", F.coalesce(F.sum(F.size("targets")).over(inner), F.lit(0)))
    return placed.join(bases, "block").select("idx", (F.col("base") + F.col("inner")).alias("start"), "targets")


def map_items(pages: DataFrame, items: str, fields: dict[str, str], id_field: str = "id") -> DataFrame:
    """Records of JSON pages(page, body): one row per element of the items array; the first of repeated ids stays."""
    rows = pages.select("page", F.posexplode(F.from_json(F.get_json_object("body", "$." + items), "array<variant>")).alias("at", "item"))
    out = rows.select("page", "at", *(F.expr(f"try_variant_get(item, '$.{path}', 'string')").alias(name) for name, path in fields.items()))
    first = out.groupBy(id_field).agg(F.min_by(F.struct(*out.columns), F.struct("page", "at")).alias("r"))
    return first.select("r.*").drop("page", "at")


def kubernetes(objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, owner edges and unresolved owners of objects(body) in JSON."""
    get = lambda p: F.get_json_object("body", "$." + p)
    rows = objects.select(
        F.coalesce(F.concat(F.lit("uid:"), get("metadata.uid")), F.concat_ws(":", get("apiVersion"), get("kind"), F.coalesce(get("metadata.namespace"), F.lit("")), get("metadata.name"))).alias("id"),
        get("metadata.name").alias("title"), get("kind").alias("kind"),
        F.from_json(get("metadata.labels"), "map<string,string>").alias("labels"),
        F.from_json(get("metadata.ownerReferences"), "array<struct<uid:string>>").alias("owners"),
    )
    labels = F.transform(F.map_entries(F.coalesce("labels", F.create_map())), lambda e: F.concat(F.lit("label:"), e.key, F.lit("="), e.value))
    nodes = rows.select("id", "title", "kind", F.array_sort(F.array_distinct(F.concat(F.array(F.lit("kubernetes"), "kind"), labels))).alias("tags"))
    refs = rows.select(F.explode("owners.uid").alias("uid"), F.col("id").alias("dst")).select(F.concat(F.lit("uid:"), "uid").alias("src"), "dst")
    known = nodes.select(F.col("id").alias("src"))
    return nodes, refs.join(known, "src", "left_semi"), refs.join(known, "src", "left_anti")
