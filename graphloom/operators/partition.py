"""Partitions of a graph and coarser graphs made of them."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.tables import settle
from . import pages as P
from .analytics import first_seen, sequential


#: Of refinement: passes at most, and how far a part's size may be from the mean.
PASSES, BALANCE = 8, 0.1


def regions(g: Graph, parts: int) -> DataFrame:
    """idx, part: regions grown breadth first to ceil(n / parts) nodes each, the last taking the rest. One task: order decides.

    A region that is full leaves its frontier behind; the next one begins at the lowest free node, and so does a region
    whose component is used up. Neighbours are taken in index order.
    """

    def grow(n: int, at, dst):
        import numpy as np

        part, full, seed = np.full(n, -1), -(-n // parts), 0
        for now in range(parts):
            room, queue = (n if now == parts - 1 else full), deque()
            while room:
                if not queue:
                    while seed < n and part[seed] >= 0:
                        seed += 1
                    if seed == n:
                        return part
                    part[seed], room = now, room - 1
                    queue.append(seed)
                    continue
                v = queue.popleft()
                near = dst[at[v] : at[v + 1]]
                free = near[part[near] < 0][:room]
                part[free], room = now, room - len(free)
                queue.extend(free.tolist())
        return part

    return sequential(g, grow, "part", distinct=True)


def refined(g: Graph, owners: DataFrame, parts: int) -> DataFrame:
    """idx, part: nodes moved one by one, in index order, to the part that most of their links lead to, where that cuts fewer edges and keeps sizes within BALANCE of the mean. One task: order decides."""
    first = P.store(owners.filter("part >= 0").select("idx", "part"), "idx", g.nodes.count(), "owners")

    def improve(n: int, at, dst):
        import numpy as np

        part = np.full(n, -1)
        for k in range(len(first.files)):
            own = first.read(k, ["idx", "part"])
            part[own["idx"]] = own["part"]
        if n and part.min() < 0:
            raise ValueError(f"node {part.argmin()} has no part")
        sizes = np.bincount(part, minlength=parts)
        most, least = math.ceil((1 + BALANCE) * n / parts), math.floor((1 - BALANCE) * n / parts)
        for _ in range(PASSES if parts > 1 else 0):
            moved = False
            for v in range(n):
                near, here = dst[at[v] : at[v + 1]], part[v]
                links = np.bincount(part[near[near != v]], minlength=parts)
                own, links[here] = links[here], 0
                to = links.argmax()
                if links[to] > own and sizes[to] < most and sizes[here] - 1 >= least:
                    part[v], moved = to, True
                    sizes[here] -= 1
                    sizes[to] += 1
            if not moved:
                break
        return part

    return sequential(g, improve, "part")


def first_touch(g: Graph) -> DataFrame:
    """idx, part: pairs by the first edge, in edge order, whose ends are both free; single nodes follow. One task, as order decides: edges pass through it page by page, and it holds eight bytes a node."""
    n = g.nodes.count()
    edges = P.store(g.edges.select("eidx", "src", "dst"), "eidx", g.edges.count(), "edges")

    def run(batches):
        import numpy as np

        for _ in P.numbers(batches):
            part, now = np.full(n, -1), 0
            for k in range(len(edges.files)):
                ends = edges.read(k, ["src", "dst"])
                for a in range(0, len(ends["src"]), 1 << 16):
                    src, dst = ends["src"][a : a + (1 << 16)], ends["dst"][a : a + (1 << 16)]
                    free = np.flatnonzero((src != dst) & (part[src] < 0) & (part[dst] < 0))
                    for s, t in zip(src[free].tolist(), dst[free].tolist(), strict=True):
                        if part[s] < 0 and part[t] < 0:
                            part[s] = part[t] = now
                            now += 1
            alone = np.flatnonzero(part < 0)
            part[alone] = np.arange(now, now + len(alone))
            yield from P.batches(idx=np.arange(n), part=part)

    return P.tasks(g.nodes.sparkSession, 1).mapInArrow(run, "idx bigint, part bigint")


def cascade(g: Graph, levels: int = 8, target: int = 50, match=None) -> list[tuple[Graph, DataFrame | None]]:
    """(graph, its nodes' part in the next coarser graph) from the finest to the coarsest, whose parts are None.

    Stops at the target size, at so many levels, or where a round leaves more than a node for each 1.6 nodes before it.
    """
    match = match or matching
    out, now = [], g
    size = now.nodes.count()
    while len(out) + 1 < levels and size > target:
        parts = settle(match(now), "parts")
        links = settle(contract(now, parts), "coarse")
        nodes = settle(parts.select(F.col("part").alias("idx")).distinct().withColumn("id", F.col("idx").cast("string")), "coarse")
        left = nodes.count()
        if left == size:
            break
        out.append((now, parts))
        now = Graph(nodes, links.select(F.monotonically_increasing_id().alias("eidx"), "src", "dst"))
        ratio, size = size / max(left, 1), left
        if ratio < 1.6:
            break
    return [*out, (now, None)]


def contract(g: Graph, owners: DataFrame) -> DataFrame:
    """src, dst, weight: links between the parts of owners(idx, part), src < dst, with the number of edges in them."""
    at = lambda col, name: owners.select(F.col("idx").alias(col), F.col("part").alias(name))
    cross = g.edges.join(at("src", "a"), "src").join(at("dst", "b"), "dst").filter("a <> b")
    return cross.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").alias("weight"))


def matching(g: Graph) -> DataFrame:
    """idx, part: pairs of a maximal matching (single nodes stay alone), numbered by first node.

    Each round an edge whose seeded hash is least at both of its ends is taken, and what touches it goes; about half of the
    edges go each round. Stops when none is left.
    """
    left = settle(g.edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "left")
    taken = None
    step = 0
    while left.limit(1).count():
        step += 1
        rated = left.withColumn("h", F.struct(F.xxhash64("u", "v", F.lit(step)).alias("h"), "u", "v"))
        ends = rated.select(F.col("u").alias("idx"), "h").unionAll(rated.select(F.col("v").alias("idx"), "h"))
        least = ends.groupBy("idx").agg(F.min("h").alias("h"))
        best = settle(least.groupBy("h").agg(F.count("*").alias("n")).filter("n = 2").select("h.u", "h.v"), "matched")
        taken = best if taken is None else taken.unionAll(best)
        gone = best.select(F.col("u").alias("x")).unionAll(best.select(F.col("v").alias("x")))
        left = settle(left.join(gone, left.u == gone.x, "left_anti").join(gone, left.v == gone.x, "left_anti"), "left")
    if taken is None:
        return first_seen(g.nodes.select("idx", F.col("idx").alias("root")), "root", "part")
    roots = g.nodes.select("idx").join(taken.select(F.col("v").alias("idx"), F.col("u").alias("root")), "idx", "left")
    return first_seen(roots.select("idx", F.coalesce("root", "idx").alias("root")), "root", "part")


def prolong(positions: DataFrame, owners: DataFrame, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """idx, x, y, z: each node at the place of its part in positions(part, x, y, z), moved by at most jitter."""
    shift = lambda k: (F.pmod(F.xxhash64("idx", F.lit(seed + k)), F.lit(2_000_001)) / 1e6 - 1) * jitter
    return owners.join(positions, "part").select("idx", *((F.col(c) + shift(k)).alias(c) for k, c in enumerate("xyz")))


def fold(positions: DataFrame, owners: DataFrame) -> DataFrame:
    """part, x, y, z: the mean place of a part's nodes in positions(idx, x, y, z)."""
    return positions.join(owners, "idx").groupBy("part").agg(*(F.avg(c).alias(c) for c in "xyz"))
