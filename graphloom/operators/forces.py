"""Force-directed layouts as rounds of DataFrame programs, by name in ENGINES.

Repulsion of all nodes comes from a tree of cells: a node meets a cell as a whole where the cell is small against its
distance, and what is in the cell otherwise. The tree is a table of cells by depth; one join per depth takes all nodes
down it. With theta = 0 the sum is exact and goes over all pairs, block by block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.tables import settle
from . import layout, partition
from . import pages as P
from .analytics import bfs
from .measures import swing

AXES = ("x", "y", "z")
#: Up to this depth all cells (8 ** depth) are few enough to be sent to every task.
BROADCAST_DEPTH = 5
#: Points that a task of the exact sum takes, and the sides of the tiles of pairs that it goes through.
TARGETS, HIGH, WIDE = 4096, 64, 1024


def _r2(a: str = "", b: str = "c") -> Column:
    return sum(((F.col(a + c) - F.col(b + c)) ** 2 for c in "yz"), (F.col(a + "x") - F.col(b + "x")) ** 2)


def exact_field(points: DataFrame, least: float, added: bool, power: float) -> DataFrame:
    """far_field of all pairs, none left out: each task sums for TARGETS points and reads all points a page at a time, so nothing is stored per pair."""
    stored = P.store(points.select("idx", *AXES, F.col("mass").cast("double").alias("mass")), "idx", points.count(), "points")
    mine = [(k, a) for k, f in enumerate(stored.files) for a in range(0, f[3], TARGETS)]

    def run(batches):
        import numpy as np

        for t in P.numbers(batches):
            k, start = mine[t]
            own = {c: v[start : start + TARGETS] for c, v in stored.read(k, ["idx", *AXES]).items()}
            sums = {c: np.zeros(len(own["idx"])) for c in AXES}
            tiles = {c: np.empty((HIGH, WIDE)) for c in [*AXES, "below", "square"]}  # made once: they stay in the cache
            for j in range(len(stored.files)):
                other = stored.read(j, [*AXES, "mass"])
                wide = [c for c in AXES if np.any(own[c] != own[c][0]) or np.any(other[c] != own[c][0])]  # in other axes nothing is apart
                for b in range(0, len(other["mass"]), WIDE):
                    there = {c: other[c][b : b + WIDE] for c in [*wide, "mass"]}
                    for a in range(0, len(own["idx"]), HIGH):
                        part = np.s_[: len(own["idx"][a : a + HIGH]), : len(there["mass"])]
                        below, square = tiles["below"][part], tiles["square"][part]
                        below.fill(0.0)
                        for c in wide:
                            d = np.subtract(own[c][a : a + HIGH, None], there[c], out=tiles[c][part])
                            below += np.multiply(d, d, out=square)
                        below = np.add(below, least, out=below) if added else np.maximum(below, least, out=below)
                        weight = np.divide(there["mass"], below if power == 1 else np.power(below, power, out=square), out=below)
                        for c in wide:  # a point is not apart from itself, which adds 0
                            sums[c][a : a + HIGH] += np.einsum("ij,ij->i", weight, tiles[c][part])
            yield from P.batches(idx=own["idx"], **{"f" + c: sums[c] for c in AXES})

    return P.tasks(points.sparkSession, len(mine)).mapInArrow(run, "idx bigint, fx double, fy double, fz double")


def far_field(points: DataFrame, theta: float = 0.7, depth: int | None = None, least: float = 1e-4, added: bool = False, power: float = 1.0) -> DataFrame:
    """idx, fx, fy, fz: sum over other points(idx, x, y, z, mass) of mass * d / max(r^2, least) ** power, d pointing away from them; r^2 + least instead of the larger one if added."""
    box = points.agg(F.count("*").alias("n"), *(F.min(c).alias("l" + c) for c in AXES), *(F.max(c).alias("h" + c) for c in AXES)).first()
    zero = points.select("idx", *(F.lit(0.0).alias("f" + c) for c in AXES))
    if not box["n"]:
        return zero
    if theta == 0:
        return exact_field(points, least, added, power)
    side = max(max(box["h" + c] - box["l" + c] for c in AXES), 1e-9) * (1 + 1e-9)
    depth = depth or min(20, max(1, math.ceil(math.log2(box["n"] + 1) / 2) + 2))
    at = {f"k{c}": F.least(F.floor((F.col(c) - box["l" + c]) / side * (1 << depth)), F.lit((1 << depth) - 1)).cast("int") for c in AXES}
    placed = settle(points.select("idx", *AXES, "mass").withColumns(at), "placed")
    keys = [f"k{c}" for c in AXES]

    def cells(d: int) -> DataFrame:
        up = [F.shiftright(k, depth - d).alias(k) for k in keys]
        mass = F.sum("mass")
        return placed.select(*up, *AXES, "mass", "idx").groupBy(*keys).agg(
            F.count("*").alias("n"), mass.alias("m"), *((F.sum(F.col(c) * F.col("mass")) / F.when(mass == 0, 1).otherwise(mass)).alias("c" + c) for c in AXES), F.min("idx").alias("only")
        )

    below = _r2() + least if added else F.greatest(_r2(), F.lit(least))
    below = below if power == 1 else F.pow(below, F.lit(power))
    push = [(F.col("m") * (F.col(c) - F.col("c" + c)) / below).alias("f" + c) for c in AXES]
    front = placed.select("idx", *AXES).crossJoin(F.broadcast(cells(0)))  # one cell
    sums = None
    for d in range(depth + 1):
        size = side / (1 << d)
        single = F.col("n") == 1
        whole = single | (F.lit(size * size) < theta * theta * _r2())
        front = settle(front, "front")
        done = front.filter(whole).filter(~(single & (F.col("only") == F.col("idx")))).select("idx", *push)
        open_ = front.filter(~whole).select("idx", *AXES, *keys)
        if d == depth:  # points of one smallest cell meet one by one
            inner = placed.select(*keys, F.col("idx").alias("only"), F.col("mass").alias("m"), *(F.col(c).alias("c" + c) for c in AXES))
            done = done.unionAll(open_.join(inner, keys).filter("only <> idx").select("idx", *push))
        else:
            children = cells(d + 1).select(*(F.shiftright(k, 1).alias("p" + k) for k in keys), "*")
            children = F.broadcast(children) if d + 1 <= BROADCAST_DEPTH else children
            parents = open_.select("idx", *AXES, *(F.col(k).alias("p" + k) for k in keys))
            front = parents.join(children, ["p" + k for k in keys]).drop(*("p" + k for k in keys))
        part = done.groupBy("idx").agg(*(F.sum("f" + c).alias("f" + c) for c in AXES))
        sums = part if sums is None else sums.unionAll(part)
    return sums.unionAll(zero).groupBy("idx").agg(*(F.sum("f" + c).alias("f" + c) for c in AXES))


def _add(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("idx").agg(*(F.sum("f" + c).alias("f" + c) for c in AXES))


def along_edges(g: Graph, pos: DataFrame, law) -> DataFrame:
    """idx, fx, fy, fz: sum over edges of law(length) * d, d pointing to the other end; of parallel edges each counts."""
    links = g.adjacency().groupBy("src", "dst").agg(F.count("*").alias("w"))
    a = pos.select(F.col("idx").alias("src"), *AXES)
    met = links.join(a, "src").join(pos.select(F.col("idx").alias("dst"), *(F.col(c).alias("c" + c) for c in AXES)), "dst").withColumn("r", F.sqrt(_r2()))
    return met.groupBy(F.col("src").alias("idx")).agg(*(F.sum(F.col("w") * law(F.col("r")) * (F.col("c" + c) - F.col(c))).alias("f" + c) for c in AXES))


@dataclass
class Engine:
    """A layout that moves in steps: init(), then step() until halted; pos is idx, x, y, z."""

    params: dict = field(default_factory=dict)

    def init(self, g: Graph, pos: DataFrame | None = None) -> Engine:
        self.g, self.n, self.steps, self.halted = g, g.nodes.count(), 0, False
        self.pos = settle(pos if pos is not None else layout.seed_circle(g.nodes, self.n), "positions")
        self.start()
        return self

    def start(self) -> None:
        pass

    def step(self) -> DataFrame:
        if self.n and not self.halted:
            self.pos = settle(self.move(), "positions")
        self.steps += 1
        return self.pos

    def run(self, steps: int) -> DataFrame:
        for _ in range(steps):
            self.step()
        return self.pos

    def move(self) -> DataFrame:
        raise NotImplementedError

    def get(self, name: str, default):
        return self.params.get(name, default)


class ForceAtlas(Engine):
    """Degree-weighted repulsion, attraction along edges, gravity, and speeds that fall where a node swings; theta = 0 is the exact one."""

    theta = 0.7

    def start(self) -> None:
        near = self.g.adjacency().groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("degree"))
        self.degrees = settle(self.g.nodes.select("idx").join(near, "idx", "left").na.fill(0), "degrees")
        self.old = self.pos.select("idx", *(F.lit(0.0).alias("f" + c) for c in AXES))
        self.speed, self.efficiency = 1.0, 1.0

    def forces(self) -> DataFrame:
        scaling, gravity, log = self.get("scaling", 2.0), self.get("gravity", 1.0), self.get("lin_log", False)
        heavy = self.pos.join(self.degrees, "idx").withColumn("mass", (F.col("degree") + 1).cast("double"))
        far = far_field(heavy, self.get("theta", self.theta)).join(self.degrees, "idx")
        far = far.select("idx", *((F.col("f" + c) * scaling * (F.col("degree") + 1)).alias("f" + c) for c in AXES))
        long = lambda r: F.greatest(r, F.lit(1e-3))
        near = along_edges(self.g, self.pos, lambda r: F.log(1 + long(r)) / long(r) if log else F.lit(1.0))
        r0 = F.greatest(F.sqrt(sum((F.col(c) ** 2 for c in "yz"), F.col("x") ** 2)), F.lit(1e-3))
        pull = gravity * F.col("mass") / (F.lit(1.0) if self.get("strong_gravity", False) else r0)
        return _add(far, near, heavy.select("idx", *((-F.col(c) * pull).alias("f" + c) for c in AXES)))

    def _adapt(self, swinging: float, traction: float) -> None:
        """The speed of the whole from how much it swings: larger graphs bear more, and it rises by half at most."""
        if not (swinging > 0 and traction > 0 and self.n):
            return
        tolerance, most = self.get("jitter_tolerance", 1.0), 10.0
        ideal = 0.05 * math.sqrt(self.n)
        jitter = tolerance * max(math.sqrt(ideal), min(most, ideal * traction / self.n**2))
        if swinging / traction > 2:
            self.efficiency *= 0.5 if self.efficiency > 0.05 else 1
            jitter = max(jitter, tolerance)
        target = jitter * self.efficiency * traction / swinging
        if swinging > jitter * traction:
            self.efficiency *= 0.7 if self.efficiency > 0.05 else 1
        elif self.speed < 1000:
            self.efficiency *= 1.3
        self.speed += min(target - self.speed, 0.5 * self.speed)

    def move(self) -> DataFrame:
        force = settle(self.forces(), "forces")
        row = swing(force, self.old, self.degrees).first()
        self._adapt(row["swinging"], row["traction"])
        old = self.old.select("idx", *(F.col("f" + c).alias("o" + c) for c in AXES))
        rows = self.pos.join(force, "idx").join(old, "idx").join(self.degrees, "idx")
        swung = (F.col("degree") + 1) * F.sqrt(sum(((F.col("o" + c) - F.col("f" + c)) ** 2 for c in "yz"), (F.col("ox") - F.col("fx")) ** 2))
        size = F.sqrt(sum((F.col("f" + c) ** 2 for c in "yz"), F.col("fx") ** 2))
        factor, cap = self.speed / (1 + F.sqrt(self.speed * swung)), self.get("max_displacement", 10.0)
        factor = F.when((size > 1e-9) & F.lit(cap > 0), F.least(factor, cap / size)).otherwise(factor)
        self.old = force
        return rows.select("idx", *((F.col(c) + F.col("f" + c) * factor * self.get("time_step", 1.0)).alias(c) for c in AXES))


class ForceAtlasExact(ForceAtlas):
    theta = 0.0


class FruchtermanReingold(Engine):
    """Repulsion k^2 / d, attraction d^2 / k, steps capped by a temperature that falls evenly over the planned steps."""

    def move(self) -> DataFrame:
        k = self.get("radius", 100.0) / math.sqrt(self.n)
        far = far_field(self.pos.withColumn("mass", F.lit(1.0)), self.get("theta", 0.7), added=True).select("idx", *((F.col("f" + c) * k * k).alias("f" + c) for c in AXES))
        force = _add(far, along_edges(self.g, self.pos, lambda r: F.sqrt(r * r + 1e-4) / k))
        heat = k * 0.1 * max(1 - self.steps / self.get("planned", 50), 0.05)
        size = F.sqrt(sum((F.col("f" + c) ** 2 for c in "yz"), F.col("fx") ** 2) + 1e-12)
        return self.pos.join(force, "idx").select("idx", *((F.col(c) + F.col("f" + c) * F.least(size, F.lit(heat)) / size).alias(c) for c in AXES))


class Stress(Engine):
    """Distances to far-apart pivots drawn to their hops: each round every node, and every pivot, takes the mean of its pairs' moves, min(1, eta / d^2) of half of what is amiss."""

    def start(self) -> None:
        self.pivots = layout.pivots(self.g, min(self.get("pivots", 8), self.n)) if self.n else []
        hops = None
        for p in self.pivots:
            own = bfs(self.g, p).filter("distance > 0").select(F.lit(p).cast("long").alias("p"), "idx", F.col("distance").cast("double").alias("d"))
            hops = own if hops is None else hops.unionAll(own)
        self.hops = settle(hops, "hops") if hops is not None else None

    def move(self) -> DataFrame:
        low, high, rounds = self.get("eta_min", 0.1), self.get("eta_max", 100.0), self.get("rounds", 30)
        eta = low if self.steps >= rounds else high * max(low / high, 1e-9) ** (self.steps / rounds)
        at = F.broadcast(self.pos.filter(F.col("idx").isin(self.pivots)).select(F.col("idx").alias("p"), *(F.col(c).alias("c" + c) for c in AXES)))  # a row per pivot
        pairs = self.hops.join(self.pos, "idx").join(at, "p").withColumn("r", F.greatest(F.sqrt(_r2()), F.lit(1e-6)))
        pairs = pairs.withColumn("h", 0.5 * F.least(eta / (F.col("d") * F.col("d")), F.lit(1.0)) * (F.col("r") - F.col("d") * self.get("length", 30.0)) / F.col("r"))
        moves = [(F.col("h") * (F.col(c) - F.col("c" + c))) for c in AXES]
        both = pairs.select("idx", *((-m).alias("f" + c) for c, m in zip(AXES, moves))).unionAll(pairs.select(F.col("p").alias("idx"), *(m.alias("f" + c) for c, m in zip(AXES, moves))))
        mean = both.groupBy("idx").agg(*(F.avg("f" + c).alias("f" + c) for c in AXES))
        return self.pos.join(mean, "idx", "left").na.fill(0.0).select("idx", *((F.col(c) + F.col("f" + c)).alias(c) for c in AXES))


class Compound(Engine):
    """Inverse-square repulsion and springs with damped speeds."""

    def start(self) -> None:
        self.speed = self.pos.select("idx", *(F.lit(0.0).alias("f" + c) for c in AXES))

    def move(self) -> DataFrame:
        push, pull, ideal = self.get("repulsion", 4500.0), self.get("elasticity", 0.45), self.get("ideal", 50.0)
        far = far_field(self.pos.withColumn("mass", F.lit(1.0)), self.get("theta", 0.7), least=1.0, power=1.5).select("idx", *((F.col("f" + c) * push).alias("f" + c) for c in AXES))
        near = along_edges(self.g, self.pos, lambda r: pull * (r - ideal) / F.greatest(r, F.lit(1e-6)))
        keep = self.speed.select("idx", *((F.col("f" + c) * 0.1).alias("f" + c) for c in AXES))
        force = _add(far, near)
        capped = F.least(F.lit(ideal), F.greatest(F.sqrt(sum((F.col("f" + c) ** 2 for c in "yz"), F.col("fx") ** 2)), F.lit(1e-9))) / F.greatest(F.sqrt(sum((F.col("f" + c) ** 2 for c in "yz"), F.col("fx") ** 2)), F.lit(1e-9))
        self.speed = settle(_add(force.select("idx", *((F.col("f" + c) * 0.1 * capped).alias("f" + c) for c in AXES)), keep), "speeds")
        return self.pos.join(self.speed, "idx").select("idx", *((F.col(c) + F.col("f" + c)).alias(c) for c in AXES))


class Springs(Engine):
    """Springs along edges only."""

    def start(self) -> None:
        self.state = self.pos.select("idx", *AXES, *(F.lit(0.0).alias("v" + c) for c in AXES))

    def move(self) -> DataFrame:
        self.state = layout.spring_step(self.g, self.state, rest=self.get("rest", 30.0))
        return self.state.select("idx", *AXES)


class Multilevel(Engine):
    """Coarse graphs first: the inner engine lays out the coarsest one, and each finer one from the places of the coarser."""

    def move(self) -> DataFrame:
        inner, budget = ENGINES[self.get("inner", "fa2-bh")], self.get("sweeps", 4)
        levels = partition.cascade(self.g, self.get("levels", 8), self.get("target", 50))
        shape = self.get("schedule", "geometric")
        pos = None
        for k in range(len(levels) - 1, -1, -1):
            g, parents = levels[k]
            share = {"uniform": 1.0, "linear": (k + 1) / len(levels), "geometric": 2.0 ** (k + 1 - len(levels))}[shape]
            start = None if pos is None else partition.prolong(pos.withColumnRenamed("idx", "part"), levels[k][1], self.get("jitter", 1.0))
            pos = inner(self.params).init(g, start).run(max(1, round(budget * share)))
        self.halted = True
        return pos


ENGINES: dict[str, type[Engine]] = {
    "fa2-bh": ForceAtlas, "fa2-brute": ForceAtlasExact, "fruchterman-reingold": FruchtermanReingold, "sgd-stress": Stress, "fcose": Compound, "cpu-spring": Springs, "multilevel": Multilevel,
}


def engine(name: str, **params) -> Engine:
    if name not in ENGINES:
        raise ValueError(f"no engine {name}; there are {', '.join(sorted(ENGINES))}")
    return ENGINES[name](params)
