"""Graph generators and rewrites over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def _graph(spark: SparkSession, n: int, edges: DataFrame) -> Graph:
    nodes = spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("id"))
    return Graph(nodes, edges.select(F.monotonically_increasing_id().alias("eidx"), F.col("src").cast("long"), F.col("dst").cast("long")))


def path(spark, n: int) -> Graph:
    return _graph(spark, n, spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def cycle(spark, n: int) -> Graph:
    return _graph(spark, n, spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")))


def star(spark, n: int) -> Graph:
    return _graph(spark, n, spark.range(1, max(n, 1)).select(F.lit(0).alias("src"), F.col("id").alias("dst")))


def ring(spark, n: int, k: int) -> Graph:
    """Each node to its k next ones."""
    return _graph(spark, n, spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("o")).select("src", ((F.col("src") + F.col("o")) % n).alias("dst")))


def complete(spark, n: int) -> Graph:
    """All ordered pairs, each node emitting its own row of them."""
    return _graph(spark, n, spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("dst")).filter("src <> dst"))


def grid(spark, rows: int, cols: int) -> Graph:
    at = spark.range(rows * cols).select("id", (F.col("id") % cols).alias("c"), F.floor(F.col("id") / cols).alias("r"))
    right = at.filter(F.col("c") < cols - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = at.filter(F.col("r") < rows - 1).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    return _graph(spark, rows * cols, right.unionAll(down))


def clustered(spark, n: int, m: int, clusters: int, affinity: float, seed: int = 0) -> Graph:
    """m random edges; with probability affinity both ends are in one of the clusters idx mod clusters."""
    src = F.floor(F.rand(seed) * n)
    other, same = F.floor(F.rand(seed + 1) * n), F.floor(F.rand(seed + 2) * (n / clusters)) * clusters
    return _graph(spark, n, spark.range(m).select(src.alias("src"), other.alias("o"), same.alias("s"), F.rand(seed + 3).alias("p")).select("src", F.when(F.col("p") < affinity, F.least(F.col("s") + F.col("src") % clusters, F.lit(n - 1))).otherwise(F.col("o")).alias("dst")))


def reverse(g: Graph) -> Graph:
    return Graph(g.nodes, g.edges.select("eidx", F.col("dst").alias("src"), F.col("src").alias("dst")))


def subdivide(g: Graph) -> DataFrame:
    """Edges (src, dst) by name with a new node e{eidx} in the middle of each."""
    mid = F.concat(F.lit("e"), F.col("eidx").cast("string"))
    return g.edges.select(F.col("src").cast("string").alias("src"), mid.alias("dst")).unionAll(g.edges.select(mid.alias("src"), F.col("dst").cast("string").alias("dst")))


def contract(g: Graph, owner: DataFrame) -> DataFrame:
    """Distinct edges between groups of owner(idx, part)."""
    at = lambda col, name: owner.select(F.col("idx").alias(col), F.col("part").alias(name))
    return g.edges.join(at("src", "a"), "src").join(at("dst", "b"), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def remove_node(g: Graph, idx: int) -> Graph:
    return Graph(g.nodes.filter(F.col("idx") != idx), g.edges.filter((F.col("src") != idx) & (F.col("dst") != idx)))


def is_subgraph(a: Graph, b: Graph) -> bool:
    pair = lambda g: g.edges.select("src", "dst")
    return a.nodes.select("id").subtract(b.nodes.select("id")).isEmpty() and pair(a).subtract(pair(b)).isEmpty()
