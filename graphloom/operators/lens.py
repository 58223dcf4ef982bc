"""Lenses: classes, colours and sizes of nodes, colours of edges, and the fisheye's radial distortion, as columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import normalized
from ..graph import Graph
from .analytics import first_seen

SHAPES = 5


def dictionary(nodes: DataFrame, field: str) -> DataFrame:
    """idx, class: values of a field numbered in the order of their first node; nodes without one are left out."""
    held = nodes.filter(F.col(field).isNotNull()).select("idx", F.col(field).alias("_v"))
    return first_seen(held, "_v", "class")


def primary_tag(tags: Column) -> Column:
    """The first tag in order; null if there is none."""
    return F.array_min(tags)


def palette(bucket: Column, colours: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, colours)), (F.pmod(bucket, F.lit(len(colours))) + 1).cast("int"))


def shape(bucket: Column) -> Column:
    return F.pmod(bucket, F.lit(SHAPES)).cast("int")


def sizes(df: DataFrame, col: str) -> DataFrame:
    """df with size: 2 + 8 * sqrt of the value's place between the extremes; 4 where all values are equal."""
    flat = F.col("_hi") == F.col("_lo")
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    at = (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return df.crossJoin(F.broadcast(ends)).withColumn("size", F.when(flat, 4.0).otherwise(2 + 8 * F.sqrt(at))).drop("_lo", "_hi")  # one row


def gradient(df: DataFrame, col: str, stops: list[tuple[float, float, float]]) -> DataFrame:
    """df with red, green, blue: the place of the value between the extremes on a gradient of three stops."""
    low, mid, high = stops
    out = normalized(df, col, "_t")
    for i, name in enumerate(("red", "green", "blue")):
        first, second = low[i] + (mid[i] - low[i]) * F.col("_t") * 2, mid[i] + (high[i] - mid[i]) * (F.col("_t") * 2 - 1)
        out = out.withColumn(name, F.when(F.col("_t") < 0.5, first).otherwise(second))
    return out.drop("_t")


def edge_classes(g: Graph, classes: DataFrame) -> DataFrame:
    """eidx, src, dst, class: the class that both ends of classes(idx, class) share, else null."""
    at = lambda col, name: classes.select(F.col("idx").alias(col), F.col("class").alias(name))
    ends = g.edges.join(at("src", "a"), "src", "left").join(at("dst", "b"), "dst", "left")
    return ends.select("eidx", "src", "dst", F.when(F.col("a") == F.col("b"), F.col("a")).alias("class"))


def distort(points: DataFrame, alpha: float = 1.0, window: int = 4) -> DataFrame:
    """points(focus, idx, r, d) with radius: r bent around each focus so that dense places get more room.

    By ascending r (then idx) the way from one point to the next, over the mean density d of the `window` points before,
    the point itself and the `window` - 1 after it, is raised to alpha and summed; the outermost point keeps its r. The
    window is at most half of the focus's points, and at least one. A focus is one view, so its points are bounded.
    """
    ordered = Window.partitionBy("focus").orderBy("r", "idx")
    whole = Window.partitionBy("focus")
    out = points.withColumn("_p", F.greatest(F.least(F.lit(window), F.floor(F.count("*").over(whole) / 2)), F.lit(1)))
    means = [F.when(F.col("_p") == p, F.avg("d").over(ordered.rowsBetween(-p, p - 1))) for p in range(1, window + 1)]
    out = out.withColumn("_step", F.greatest(F.col("r") - F.lag("r", 1, 0.0).over(ordered), F.lit(0.0)) / F.greatest(F.coalesce(*means), F.lit(1e-6)))
    out = out.withColumn("_f", F.sum(F.pow("_step", F.lit(alpha))).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("_f").over(whole)
    scale = F.when(last > 0, F.max("r").over(whole) / last).otherwise(1.0)
    return out.withColumn("radius", F.col("_f") * scale).drop("_p", "_step", "_f")


def fill_levels(distances: DataFrame, first: int = 64) -> DataFrame:
    """focus, idx, level of distances(focus, idx, distance): nearest first (then idx, unreachable last), levels holding first, 2 * first, 4 * first, ..."""
    place = F.row_number().over(Window.partitionBy("focus").orderBy(F.asc_nulls_last("distance"), "idx")) - 1
    return distances.select("focus", "idx", F.floor(F.log2(place / F.lit(float(first)) + 1)).cast("int").alias("level"))
