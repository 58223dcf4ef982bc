"""Static layouts, one spring engine, and layout quality, as columns over a dense index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, dense_index
from ..plans.tables import settle
from . import pairs
from .analytics import bfs


def circle(nodes: DataFrame, n: int, radius: float = 100.0) -> DataFrame:
    t = F.col("idx") * (2 * math.pi / max(n, 1))
    return nodes.select("idx", (F.cos(t) * radius).alias("x"), (F.sin(t) * radius).alias("y"), F.lit(0.0).alias("z"))


def seed_circle(nodes: DataFrame, n: int) -> DataFrame:
    return circle(nodes, n, 200 + 4 * math.sqrt(n))


def grid(nodes: DataFrame, n: int, spacing: float = 10.0, aspect: float = 1.0) -> DataFrame:
    cols = max(1, math.ceil(math.sqrt(n * aspect)))
    rows = max(1, math.ceil(n / cols))
    x, y = F.col("idx") % cols - (cols - 1) / 2, F.floor(F.col("idx") / cols) - (rows - 1) / 2
    return nodes.select("idx", (x * spacing).alias("x"), (y * spacing).alias("y"), F.lit(0.0).alias("z"))


def sphere(nodes: DataFrame, n: int, radius: float = 100.0) -> DataFrame:
    """Fibonacci sphere: equal areas by latitude, golden steps around."""
    lat, turn = 1 - 2 * (F.col("idx") + 0.5) / max(n, 1), F.col("idx") * (math.pi * (3 - math.sqrt(5)))
    flat = F.sqrt(1 - lat * lat) * radius
    return nodes.select("idx", (flat * F.cos(turn)).alias("x"), (lat * radius).alias("y"), (flat * F.sin(turn)).alias("z"))


def concentric(scores: DataFrame, gap: float = 50.0) -> DataFrame:
    """Rings of equal score, the highest inside; places on a ring in index order. Scores are ranked by ranges."""
    sizes = scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("down", -F.col("score"))
    rings = dense_index(sizes, "down").select("score", "n", F.col("idx").cast("int").alias("ring"))
    placed = scores.join(rings, "score").withColumn("k", F.row_number().over(Window.partitionBy("score").orderBy("idx")) - 1)
    t = F.col("k") * 2 * math.pi / F.col("n")
    return placed.select("idx", "ring", (F.cos(t) * F.col("ring") * gap).alias("x"), (F.sin(t) * F.col("ring") * gap).alias("y"))


def spring_step(g: Graph, state: DataFrame, dt: float = 0.1, k: float = 0.05, rest: float = 1.0, damping: float = 0.9) -> DataFrame:
    """One semi-implicit step of state(idx, x, y, z, vx, vy, vz) under edge springs."""
    a = state.select(F.col("idx").alias("src"), "x", "y", "z")
    b = state.select(F.col("idx").alias("dst"), *(F.col(c).alias(c + "2") for c in "xyz"))
    pairs = g.adjacency().join(a, "src").join(b, "dst")
    d = F.sqrt(sum(((F.col(c + "2") - F.col(c)) ** 2 for c in "yz"), (F.col("x2") - F.col("x")) ** 2))
    pull = pairs.withColumn("d", F.greatest(d, F.lit(1e-9))).withColumn("f", k * (F.col("d") - rest) / F.col("d"))
    force = pull.groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("deg"), *(F.sum(F.col("f") * (F.col(c + "2") - F.col(c))).alias("f" + c) for c in "xyz"))
    moved = state.join(force, "idx", "left").na.fill(0)
    speed = {c: (F.col("v" + c) * damping + dt * F.col("f" + c)) / (1 + dt * k * F.col("deg")) for c in "xyz"}
    return settle(moved.select("idx", *((F.col(c) + dt * speed[c]).alias(c) for c in "xyz"), *(speed[c].alias("v" + c) for c in "xyz")), "springs")


def edge_lengths(g: Graph, pos: DataFrame) -> DataFrame:
    a = pos.select(F.col("idx").alias("src"), "x", "y", "z")
    b = pos.select(F.col("idx").alias("dst"), *(F.col(c).alias(c + "2") for c in "xyz"))
    return g.edges.join(a, "src").join(b, "dst").withColumn("length", F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2 + (F.col("z2") - F.col("z")) ** 2))


def length_variation(g: Graph, pos: DataFrame) -> DataFrame:
    """One row: population deviation of edge lengths over their mean; 0 for fewer than two edges or a tiny mean."""
    return edge_lengths(g, pos).agg(F.when((F.count("*") < 2) | (F.avg("length") < 1e-12), 0.0).otherwise(F.stddev_pop("length") / F.avg("length")).alias("cv"))


def scaled_stress(cross: str, own: str, n: str) -> Column:
    """Stress per pair at the best scale, of the sums of distance / hops and of its square over n pairs."""
    a = F.when(F.col(own) > 0, F.col(cross) / F.col(own)).otherwise(0.0)
    return (a * a * F.col(own) - 2 * a * F.col(cross) + F.col(n)) / F.greatest(n, F.lit(1))


def stress(pairs: DataFrame) -> DataFrame:
    """One row: scale-normalised stress of pairs (d, apart): hops and distance in the layout, weights 1 / d^2."""
    ratio = F.col("apart") / F.col("d")
    sums = pairs.filter("d > 0").agg(F.sum(ratio).alias("cross"), F.sum(ratio * ratio).alias("own"), F.count("*").alias("n"))
    return sums.select(scaled_stress("cross", "own", "n").alias("stress"))


def crossings(g: Graph, pos: DataFrame, cell: float, step: float | None = None) -> DataFrame:
    """One row: proper crossings of edges in the plane. Edges of like size (doublings of cell) and place are compared where their boxes meet.

    With a step, if all places lie on a lattice of it, those of a hub's many edges are counted by their order, not by pairs.
    """
    return pairs.crossings(edge_lengths(g, pos), pos, cell, step)


def contacts(points: DataFrame, scale: float, cell: float) -> DataFrame:
    """Pairs of points(idx, x, y, z, r) no further apart than scale * (r + r2), found among 27 cells; cell >= that distance."""
    at = {c: F.floor(F.col(c) / cell).alias("c" + c) for c in "xyz"}
    a = points.select("*", *at.values())
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    b = a.withColumn("o", F.explode(near)).select(*(F.col(c).alias(c + "2") for c in ("idx", "x", "y", "z", "r")), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), (F.col("cz") + F.col("o.k")).alias("cz"))
    d = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 + (F.col("z") - F.col("z2")) ** 2)
    return a.join(b, ["cx", "cy", "cz"]).filter("idx < idx2").filter(d <= scale * (F.col("r") + F.col("r2"))).select("idx", "idx2", d.alias("distance"))


def hilbert(nodes: DataFrame, n: int, order: int = 6, extent: float = 1000.0) -> DataFrame:
    """Nodes spread evenly along a Hilbert curve of 4 ** order cells, in index order; the square is centred."""
    cells, side = 4**order, 2**order
    code = F.floor(F.col("idx") * (cells - 1) / max(n - 1, 1)).cast("long") if n > 1 else F.lit(0).cast("long")

    def turn(at: Column, k: Column) -> Column:
        """One digit of base four, from the least: the square below is mirrored or swapped, then moved to its quadrant."""
        s, digit = F.call_function("shiftleft", F.lit(1).cast("long"), k), F.pmod(F.call_function("shiftright", at.code, 2 * k), F.lit(4))
        rx, ry = F.floor(digit / 2), F.when((digit == 1) | (digit == 2), 1).otherwise(0).cast("long")
        flip = (ry == 0) & (rx == 1)
        x, y = F.when(flip, s - 1 - at.x).otherwise(at.x), F.when(flip, s - 1 - at.y).otherwise(at.y)
        return F.struct((F.when(ry == 0, y).otherwise(x) + s * rx).alias("x"), (F.when(ry == 0, x).otherwise(y) + s * ry).alias("y"), at.code.alias("code"))

    zero = F.lit(0).cast("long")
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), F.struct(zero.alias("x"), zero.alias("y"), code.alias("code")), turn)
    place = lambda c: (F.col("_at")[c] + 0.5) * (extent / side) - extent / 2
    return nodes.select("idx", walked.alias("_at")).select("idx", place("x").alias("x"), place("y").alias("y"), F.lit(0.0).alias("z"))


def clusters(members: DataFrame, radius: float = 100.0, gap: float = 50.0) -> DataFrame:
    """members(idx, cluster): each cluster on a circle of its own, in index order; circles around a circle in the order of clusters, a single one at the centre."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    ring = dense_index(sizes, "cluster").withColumnRenamed("idx", "c").crossJoin(F.broadcast(sizes.agg(F.count("*").alias("all"))))
    placed = members.join(ring, "cluster").withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("idx")) - 1)
    inner, outer = F.col("k") * 2 * math.pi / F.col("n"), F.col("c") * 2 * math.pi / F.col("all")
    away = F.when(F.col("all") > 1, 2 * radius + gap).otherwise(0.0)
    return placed.select("idx", (away * F.cos(outer) + radius * F.cos(inner)).alias("x"), (away * F.sin(outer) + radius * F.sin(inner)).alias("y"), F.lit(0.0).alias("z"))


def ball(nodes: DataFrame, radius: float = 100.0, seed: int = 0) -> DataFrame:
    """Places spread evenly in a ball, each from the hash of its index alone."""
    unit = lambda k: (F.pmod(F.xxhash64("idx", F.lit(seed), F.lit(k)), F.lit(1 << 52)) / float(1 << 52))
    r, up, around = radius * F.cbrt(unit(0)), unit(1) * 2 - 1, unit(2) * 2 * math.pi
    flat = F.sqrt(1 - up * up)
    return nodes.select("idx", (r * flat * F.cos(around)).alias("x"), (r * flat * F.sin(around)).alias("y"), (r * up).alias("z"))


def layered(g: Graph, gap: float = 100.0, apart: float = 50.0, direction: str = "TB") -> DataFrame:
    """idx, layer, x, y, z: layers by hops along edges from the roots (nodes that no edge enters; if none, the first node).

    A layer is ordered by the mean place of its nodes' predecessors, then index; what no root reaches joins the last layer.
    """
    edges = settle(g.edges.select("src", "dst").filter("src <> dst").distinct(), "links")
    front = g.nodes.select("idx").join(edges.select(F.col("dst").alias("idx")), "idx", "left_anti")
    front = settle(front if front.limit(1).count() else g.nodes.select("idx").filter("idx = 0"), "front")
    place = Window.partitionBy("layer").orderBy("mean", "idx")
    ranked = lambda df, layer: settle(df.withColumn("layer", F.lit(layer)).withColumn("k", F.row_number().over(place) - 1).select("idx", "layer", "k"), "layer")
    now = ranked(front.withColumn("mean", F.lit(0.0)), 0)
    seen, layer = now, 0
    while True:
        step = edges.join(now.select(F.col("idx").alias("src"), "k"), "src").groupBy(F.col("dst").alias("idx")).agg(F.avg("k").alias("mean"))
        now = ranked(step.join(seen, "idx", "left_anti"), layer + 1)
        if not now.limit(1).count():
            break
        layer += 1
        seen = settle(seen.unionAll(now), "seen")
    rest = g.nodes.select("idx").join(seen, "idx", "left_anti")
    size = seen.filter(F.col("layer") == layer).count()
    rest = dense_index(rest.select(F.col("idx").alias("node")), "node")
    seen = seen.unionAll(rest.select(F.col("node").alias("idx"), F.lit(layer).alias("layer"), (F.col("idx") + size).cast("int").alias("k")))
    sizes = seen.groupBy("layer").agg(F.count("*").alias("n"))
    down, across = F.col("layer") * gap * (-1 if direction in ("BT", "RL") else 1), (F.col("k") - (F.col("n") - 1) / 2) * apart
    x, y = (down, across) if direction in ("LR", "RL") else (across, down)
    return seen.join(sizes, "layer").select("idx", "layer", x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))


def pivots(g: Graph, k: int) -> list[int]:
    """Up to k nodes far from each other: the first, then each time the node farthest from those chosen (unreached ones farthest, least index on ties)."""
    chosen, near = [0], None
    while len(chosen) < k:
        step = bfs(g, chosen[-1]).select("idx", F.coalesce("distance", F.lit(1 << 30)).alias("d"))
        near = settle(step if near is None else near.join(step.withColumnRenamed("d", "e"), "idx").select("idx", F.least("d", "e").alias("d")), "near")
        best = near.orderBy(F.desc("d"), "idx").first()
        if best is None or best["d"] == 0:
            break
        chosen.append(best["idx"])
    return chosen


def spread(points: DataFrame, group: str) -> DataFrame:
    """Per group of points(x, y, z): its centre and radius of gyration."""
    sums = points.groupBy(group).agg(*(F.avg(c).alias("c" + c) for c in "xyz"), F.avg(sum((F.col(c) ** 2 for c in "yz"), F.col("x") ** 2)).alias("_r2"))
    centre = sum((F.col("c" + c) ** 2 for c in "yz"), F.col("cx") ** 2)
    return sums.select(group, "cx", "cy", "cz", F.sqrt(F.greatest(F.col("_r2") - centre, F.lit(0.0))).alias("gyration"))


def angles(g: Graph, pos: DataFrame, most: int = 64) -> DataFrame:
    """centre, a, b, angle: pairs of neighbours of each node with a < b; of more than `most` pairs every (pairs // most)-th, in order."""
    near = g.neighbours()
    listed = near.groupBy(F.col("src").alias("centre")).agg(F.array_sort(F.collect_list("dst")).alias("n"))
    m = F.size("n")
    pairs = listed.select("centre", "n", F.greatest(F.floor(m * (m - 1) / 2 / most), F.lit(1)).alias("stride")).select("centre", "n", "stride", F.posexplode("n").alias("i", "a"))
    before = F.col("i") * (F.size("n") - 1) - F.col("i") * (F.col("i") - 1) / 2  # pairs whose first is earlier
    pairs = pairs.select("centre", "stride", "a", before.cast("long").alias("first"), F.posexplode(F.slice("n", F.col("i") + 2, F.size("n"))).alias("j", "b"))
    kept = pairs.filter(F.pmod(F.col("first") + F.col("j"), F.col("stride")) == 0).select("centre", "a", "b")
    at = lambda col, p: pos.select(F.col("idx").alias(col), *(F.col(c).alias(p + c) for c in "xyz"))
    met = kept.join(at("centre", "o"), "centre").join(at("a", "p"), "a").join(at("b", "q"), "b")
    u, v = [[F.col(p + c) - F.col("o" + c) for c in "xyz"] for p in "pq"]
    dot = lambda r, s: r[0] * s[0] + r[1] * s[1] + r[2] * s[2]
    cos = dot(u, v) / F.greatest(F.sqrt(dot(u, u) * dot(v, v)), F.lit(1e-12))
    return met.select("centre", "a", "b", F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))).alias("angle"))


def spectral(g: Graph, rounds: int = 30, scale: float = 100.0) -> DataFrame:
    """idx, x, y, z by the smoothest vectors of the simple graph's Laplacian L: power rounds of c I - L with c = 2 * most degree + 1.

    Each round the three vectors lose their mean and their parts along earlier ones and are scaled; only their dot
    products, six numbers, reach the driver. The largest coordinate of an axis is `scale`.
    """
    near = settle(g.neighbours(), "near")
    deg = g.nodes.select("idx").join(near.groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("deg")), "idx", "left").na.fill(0)
    deg = settle(deg, "degrees")
    n, top = deg.agg(F.count("*"), F.max("deg")).first()
    if not n:
        return deg.select("idx", *(F.lit(0.0).alias(c) for c in "xyz"))
    c = 2 * top + 1
    state = deg.select("idx", *((F.pmod(F.xxhash64("idx", F.lit(k)), F.lit(2001)) / 1000.0 - 1).alias(v) for k, v in enumerate("xyz")))
    for _ in range(rounds):
        pull = near.join(state.withColumnRenamed("idx", "dst"), "dst").groupBy(F.col("src").alias("idx")).agg(*(F.sum(v).alias("s" + v) for v in "xyz"))
        state = state.join(deg, "idx").join(pull, "idx", "left").na.fill(0.0)
        state = settle(state.select("idx", *(((c - F.col("deg")) * F.col(v) + F.col("s" + v)).alias(v) for v in "xyz")), "vectors")
        for i, v in enumerate("xyz"):
            dots = state.agg(F.avg(v), *(F.sum(F.col(v) * F.col(u)) for u in "xyz"[:i]), *(F.sum(u) for u in "xyz"[:i])).first()
            clear = F.col(v) - dots[0]
            for j, u in enumerate("xyz"[:i]):  # earlier ones are of length 1 and without mean
                clear = clear - F.lit(dots[1 + j] - dots[0] * dots[1 + i + j]) * F.col(u)
            state = state.withColumn(v, clear)
            length = math.sqrt(state.agg(F.sum(F.col(v) ** 2)).first()[0])
            state = state.withColumn(v, F.col(v) / length if length > 1e-9 else F.lit(0.0))
        state = settle(state, "vectors")
    ends = state.agg(*(F.max(F.abs(v)) for v in "xyz")).first()
    return state.select("idx", *((F.col(v) * (scale / m) if m else F.lit(0.0)).alias(v) for v, m in zip("xyz", ends, strict=True)))
