"""The graph model: node and edge tables with a dense index, and their integrity rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .plans.tables import settle


@dataclass(frozen=True)
class Graph:
    """nodes(idx, id, ...) with idx dense from 0; edges(eidx, src, dst) with the ends' idx. Edges are a multiset."""

    nodes: DataFrame
    edges: DataFrame

    def adjacency(self) -> DataFrame:
        """Both directions of each edge but for self loops; parallel edges stay."""
        e = self.edges.select("src", "dst").filter("src <> dst")
        return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def neighbours(self) -> DataFrame:
        """The adjacency without repetitions."""
        return self.adjacency().distinct()

    def dangling(self, ids: DataFrame) -> DataFrame:
        """Rows (src, dst) of named edges with an end that is no node."""
        known = self.nodes.select("id")
        return ids.join(known, ids.src == known.id, "left_anti").unionByName(
            ids.join(known, ids.src == known.id, "left_semi").join(known, ids.dst == known.id, "left_anti")
        )

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def neighbourhood(self, idx: int) -> DataFrame:
        """Neighbours of a node in index order with direction Out, In or Both; the node itself left out."""
        out = self.edges.filter(F.col("src") == idx).select(F.col("dst").alias("idx"), F.lit(1).alias("o"), F.lit(0).alias("i"))
        into = self.edges.filter(F.col("dst") == idx).select(F.col("src").alias("idx"), F.lit(0).alias("o"), F.lit(1).alias("i"))
        ends = out.unionAll(into).filter(F.col("idx") != idx).groupBy("idx").agg(F.max("o").alias("o"), F.max("i").alias("i"))
        return ends.select("idx", F.when((F.col("o") == 1) & (F.col("i") == 1), "Both").when(F.col("o") == 1, "Out").otherwise("In").alias("direction")).orderBy("idx")


def dense_index(nodes: DataFrame, *order: str) -> DataFrame:
    """Add idx, dense from 0 in the given order: sorted by ranges, then each range's place after earlier ones."""
    ranged = settle(nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_place", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return ranged.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("idx", F.col("_start") + F.col("_place") % (1 << 33)).drop("_place", "_part", "_start")


def build(nodes: DataFrame, edges: DataFrame, *order: str) -> Graph:
    """A graph from nodes(id, ...) in the given order and edges(src, dst) by id; edges with a missing end are dropped."""
    indexed = dense_index(nodes, *(order or ("id",)))
    ids = indexed.select("idx", "id")
    s, d = ids.select(F.col("idx").alias("s"), F.col("id").alias("src")), ids.select(F.col("idx").alias("d"), F.col("id").alias("dst"))
    ends = edges.join(s, "src").join(d, "dst").select(F.monotonically_increasing_id().alias("eidx"), F.col("s").alias("src"), F.col("d").alias("dst"))
    return Graph(indexed, ends)


def from_pairs(spark, n: int, pairs: list[tuple[int, int]]) -> Graph:
    """A small graph given by index pairs."""
    nodes = spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("id"))
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "eidx bigint, src bigint, dst bigint")
    return Graph(nodes, edges)


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of broken rules: repeated ids, edges with a missing end, ids that are no `kind:source:local`, positions that are not finite."""
    known = nodes.select(F.col("id").alias("_id")).distinct()
    repeated = nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n")).select(F.lit("repeated id").alias("rule"), "n")
    loose = edges.join(known, edges.src == known._id, "left_anti").unionAll(edges.join(known, edges.src == known._id, "left_semi").join(known, edges.dst == known._id, "left_anti"))
    loose = loose.agg(F.count("*").alias("n")).select(F.lit("missing end").alias("rule"), "n")
    named = nodes.agg(F.count_if(~F.col("id").rlike(r"^[a-z0-9]{1,32}:[a-z0-9._-]{1,128}:.+$") | (F.octet_length(F.substring_index("id", ":", -1)) > 512)).alias("n")).select(F.lit("malformed id").alias("rule"), "n")
    return repeated.unionAll(loose).unionAll(named)
