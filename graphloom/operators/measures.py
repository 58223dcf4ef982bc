"""Measures of layouts, steps and assemblies: sums and ranks over points and pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.tables import settle
from .analytics import components
from .layout import scaled_stress
from .pairs import stress_sums

AXES = ("x", "y", "z")


def _length(cols) -> Column:
    return F.sqrt(sum((c * c for c in cols[1:]), cols[0] * cols[0]))


def _finite(cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def nearest_rank(values: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """Per group the value of rank floor((n - 1) * q), counted from 0, in ascending order."""
    order = Window.partitionBy(group).orderBy(value)
    ranked = values.select(group, value, (F.row_number().over(order) - 1).alias("_k"), F.count("*").over(Window.partitionBy(group)).alias("_n"))
    return ranked.filter(F.col("_k") == F.floor((F.col("_n") - 1) * q)).select(group, value)


def telemetry(frames: DataFrame) -> DataFrame:
    """Per frame of frames(frame, idx, x, y, z): most (largest coordinate), p50 and p99 of the radius, mean and p50 of the displacement, not_finite.

    Points that are not finite are counted and left out of all but the number that the mean is taken over; a node's first
    frame counts as no move.
    """
    now, before = [F.col(c) for c in AXES], Window.partitionBy("idx").orderBy("frame")
    moved = _length([F.coalesce(c - F.lag(c).over(before), F.lit(0.0)) for c in now])
    rows = frames.select("frame", F.greatest(*(F.abs(c) for c in now)).alias("most"), _length(now).alias("radius"), moved.alias("move"), (_finite(now) & _finite([moved])).alias("ok"))
    good = rows.filter("ok")
    sums = rows.groupBy("frame").agg(
        F.max(F.when(F.col("ok"), F.col("most"))).alias("most"), (F.sum(F.when(F.col("ok"), F.col("move")).otherwise(0.0)) / F.count("*")).alias("mean_move"), F.count_if(~F.col("ok")).alias("not_finite")
    )
    for name, value, q in (("p50_radius", "radius", 0.5), ("p99_radius", "radius", 0.99), ("p50_move", "move", 0.5)):
        sums = sums.join(nearest_rank(good, "frame", value, q).withColumnRenamed(value, name), "frame", "left")
    return sums


def hop_pairs(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """s, idx, d: hops between each source (all nodes unless given) and every node that it reaches, breadth first from all at once."""
    near = settle(g.neighbours(), "near")
    front = settle((g.nodes if sources is None else sources).select(F.col("idx").alias("s"), "idx", F.lit(0).alias("d")), "front")
    seen, hop = front, 0
    while front.limit(1).count():
        hop += 1
        step = front.join(near, front.idx == near.src).select("s", F.col("dst").alias("idx")).distinct()
        front = settle(step.join(seen.select("s", "idx"), ["s", "idx"], "left_anti").withColumn("d", F.lit(hop)), "front")
        seen = settle(seen.unionAll(front), "seen")
    return seen


def all_pairs_stress(g: Graph, pos: DataFrame, step: float | None = None) -> DataFrame:
    """One row: pairs (i < j, in reach) and the stress of their distances against hops, at the best scale, per pair; faster if all places lie on a lattice of the step."""
    sums = stress_sums(g, pos, step).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"), F.sum("total").alias("total"), F.sum("own").alias("own"))
    half = sums.select((F.col("n") / 2).cast("long").alias("pairs"), *((F.col(c) / 2).alias(c) for c in ("total", "own")))  # each pair was met from both ends
    return half.select("pairs", scaled_stress("total", "own", "pairs").alias("stress"))


def nematic_order(directors: DataFrame) -> DataFrame:
    """One row: S = 1.5 times the largest eigenvalue of the mean of n n^T less a third, for directors(x, y, z)."""
    means = directors.agg(F.count("*").alias("n"), *(F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")))
    q = {k: F.coalesce(F.col(k), F.lit(0.0)) - (1 / 3 if k[0] == k[1] else 0.0) for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    m = means.select("n", *(v.alias(k) for k, v in q.items()))
    off = F.col("xy") ** 2 + F.col("xz") ** 2 + F.col("yz") ** 2
    m = m.withColumns({"off": off, "p": F.sqrt((F.col("xx") ** 2 + F.col("yy") ** 2 + F.col("zz") ** 2 + 2 * off) / 6)})
    xx, yy, zz, xy, xz, yz = (F.col(k) / F.col("p") for k in ("xx", "yy", "zz", "xy", "xz", "yz"))
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    turned = 2 * F.col("p") * F.cos(F.acos(F.greatest(F.least(det / 2, F.lit(1.0)), F.lit(-1.0))) / 3)
    largest = F.when(F.col("off") < 1e-18, F.greatest("xx", "yy", "zz")).otherwise(turned)
    return m.select(F.when(F.col("n") == 0, 0.0).otherwise(1.5 * largest).alias("nematic"))


def clusters(points: DataFrame, touching: DataFrame) -> DataFrame:
    """idx, cluster: components of contacts (idx, idx2) among points."""
    g = Graph(points.select("idx"), touching.select(F.monotonically_increasing_id().alias("eidx"), F.col("idx").alias("src"), F.col("idx2").alias("dst")))
    return components(g).withColumnRenamed("component", "cluster")


def cluster_sizes(members: DataFrame) -> DataFrame:
    """One row: clusters, largest and the share of all points in it."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("share"))


def closure(points: DataFrame, bands: int = 6, turns: int = 12) -> DataFrame:
    """One row: centre, gyration and closure of points(x, y, z): the solid angle, as seen from the centre, of the cells of a grid of directions that hold a point; closed from 0.85 on."""
    centre = points.agg(*(F.avg(c).alias("c" + c) for c in AXES), F.count("*").alias("n"))
    rel = points.crossJoin(F.broadcast(centre)).select(*((F.col(c) - F.col("c" + c)).alias(c) for c in AXES))  # one row
    r = _length([F.col(c) for c in AXES])
    band = F.least(F.floor(F.acos(F.greatest(F.least(F.col("z") / r, F.lit(1.0)), F.lit(-1.0))) / math.pi * bands), F.lit(bands - 1))
    turn = F.least(F.floor((F.atan2("y", "x") + math.pi) / (2 * math.pi) * turns), F.lit(turns - 1))
    cells = rel.filter(r > 1e-9).select(band.alias("band"), turn.alias("turn")).distinct()
    weight = (F.cos(F.col("band") * math.pi / bands) - F.cos((F.col("band") + 1) * math.pi / bands)) / (2 * turns)
    covered = cells.agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("closure"))
    spread = rel.agg(F.sqrt(F.avg(r * r)).alias("gyration"))
    return centre.select("cx", "cy", "cz").crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(covered)).withColumn("closed", F.col("closure") >= 0.85)


def energies(edges: DataFrame, points: DataFrame, touching: DataFrame, k: float = 0.05, rest: float = 1.0, gravity: float = 0.01, push: float = 1.0, scale: float = 1.0) -> DataFrame:
    """One row: energy of springs along edges(src, dst), of gravity, and of overlaps among touching(idx, idx2, distance); motion of points(x, y, z, vx, vy, vz, r)."""
    a = points.select(F.col("idx").alias("src"), *(F.col(c).alias(c + "1") for c in AXES))
    ends = edges.join(a, "src").join(points.select(F.col("idx").alias("dst"), *AXES), "dst")
    stretch = _length([F.col(c) - F.col(c + "1") for c in AXES]) - rest
    springs = ends.agg(F.coalesce(F.sum(0.5 * k * stretch * stretch), F.lit(0.0)).alias("springs"))
    pulled = points.agg(
        F.coalesce(F.sum(0.5 * gravity * sum((F.col(c) ** 2 for c in "yz"), F.col("x") ** 2)), F.lit(0.0)).alias("gravity"),
        F.coalesce(F.sum(0.5 * sum((F.col("v" + c) ** 2 for c in "yz"), F.col("vx") ** 2)), F.lit(0.0)).alias("kinetic"),
    )
    r = points.select("idx", "r")
    pairs = touching.join(r, "idx").join(r.select(F.col("idx").alias("idx2"), F.col("r").alias("r2")), "idx2")
    over = F.greatest(scale * (F.col("r") + F.col("r2")) - F.col("distance"), F.lit(0.0))
    exclusion = pairs.agg(F.coalesce(F.sum(0.5 * push * over * over), F.lit(0.0)).alias("exclusion"))
    return springs.crossJoin(F.broadcast(pulled)).crossJoin(F.broadcast(exclusion)).withColumn("total", F.col("springs") + F.col("gravity") + F.col("exclusion"))


def residual(forces: DataFrame) -> DataFrame:
    """One row: the largest and the root mean square of forces(fx, fy, fz)."""
    f = _length([F.col("f" + c) for c in AXES])
    return forces.agg(F.max(f).alias("most"), F.sqrt(F.avg(f * f)).alias("rms"))


def swing(forces: DataFrame, before: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row: swinging and traction over all nodes, by how forces(idx, fx, fy, fz) differ from and agree with those of the step before; pairs that are not finite are left out."""
    old = before.select("idx", *(F.col("f" + c).alias("o" + c) for c in AXES))
    rows = forces.join(old, "idx", "left").na.fill(0.0, ["o" + c for c in AXES]).join(degrees.select("idx", "degree"), "idx")
    m = F.col("degree") + 1
    swung = m * _length([F.col("o" + c) - F.col("f" + c) for c in AXES])
    drawn = m * 0.5 * _length([F.col("o" + c) + F.col("f" + c) for c in AXES])
    kept = rows.select(swung.alias("s"), drawn.alias("t")).filter(_finite([F.col("s"), F.col("t")]))
    return kept.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("swinging"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("traction"))
