"""Sums over pairs of nodes and of edges: tasks read pages of arrays and keep counts, nothing is stored per pair.

On a lattice (see `lattice`) two sums need less than all pairs, and stay exact. Edges of two hubs A and B cross where both
ends lie on one side of AB and each is seen before the other's from its own hub: a count of inversions. Distances between
two sets of places are summed by a convolution with the distance from the origin. Elsewhere all pairs are gone through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.tables import settle
from . import pages as P

#: Edges from which on a hub is a star; edges of a tile; cells along a block of the lattice; tasks that share the work.
STAR, TILE, SIDE, TASKS = 48, 512, 1024, 32


@dataclass(frozen=True)
class Lattice:
    """Cell (i, j) lies at (x + i * step, y + j * step); `cells` along the longer side."""

    x: float
    y: float
    step: float
    cells: int

    def cell(self, axis: str) -> Column:
        """The cell of column `axis`, which is called x or y, followed by any digits."""
        return F.round((F.col(axis) - getattr(self, axis[0])) / self.step).cast("long")


def lattice(pos: DataFrame, step: float | None) -> Lattice | None:
    """The lattice of this step that holds all places(x, y, z), which must be of one height; None if there is none."""
    low = pos.agg(*(F.min(c).alias(c) for c in "xyz"), F.max("x"), F.max("y")).first()
    if not step or low["x"] is None:
        return None
    on = Lattice(low["x"], low["y"], step, 1)
    away = [F.col(c) - on.cell(c) * step != low[c] for c in "xy"]
    if pos.filter(away[0] | away[1] | (F.col("z") != low["z"]) | F.isnull("x") | F.isnull("y") | F.isnull("z")).limit(1).count():
        return None
    return Lattice(low["x"], low["y"], step, 1 + round(max(low[3] - low["x"], low[4] - low["y"]) / step))


def _passed(rank, first) -> int:
    """Pairs i < j with first[i], not first[j] and rank[i] > rank[j]: bit by bit from the highest, those of equal higher bits in a row."""
    import numpy as np

    total, n = 0, len(rank)
    low, high = np.zeros(n, np.int64), np.full(n, n, np.int64)
    for bit in range(int(rank.max()).bit_length() - 1 if n else -1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        seen = np.concatenate(([0], np.cumsum(one & first)))
        last = np.flatnonzero(~one & ~first)
        total += int((seen[last] - seen[low[last]]).sum())
        ones = np.concatenate(([0], np.cumsum(one)))
        before = ones[:-1] - ones[low]
        middle = high - (ones[high] - ones[low])
        to = np.where(one, middle + before, np.arange(n) - before)
        low, high = np.where(one, middle, low), np.where(one, high, middle)
        moved = [np.empty_like(v) for v in (rank, first, low, high)]
        for old, new in zip((rank, first, low, high), moved, strict=True):
            new[to] = old
        rank, first, low, high = moved
    return total


def star_crossings(a, near_a, b, near_b) -> int:
    """Proper crossings of the edges from a to near_a with those from b to near_b: cells as integers, products of two differences below 2^26.

    Quotients of such integers are equal, or apart by more than rounding moves them, so their order is exact.
    """
    import numpy as np

    ux, uy = int(b[0] - a[0]), int(b[1] - a[1])
    if not (ux or uy):
        return 0
    x, y = (np.concatenate((near_a[k], near_b[k])) - a[k] for k in (0, 1))
    mine = np.arange(len(x)) < len(near_a[0])
    off, along, total = ux * y - uy * x, ux * x + uy * y, 0
    for side in (off > 0, off < 0):
        away, there, first = np.abs(off[side]), along[side], mine[side]
        from_a, from_b = -there / away, (there - (ux * ux + uy * uy)) / away  # grow with the angles at a and b
        order = np.lexsort((first, from_a))  # a's that are level with a b do not pass it
        total += _passed(np.unique(from_b, return_inverse=True)[1][order], first[order])
    return total


class Edges:
    """A page of edges by tiles of TILE rows with their bounding boxes."""

    COLUMNS = ("src", "dst", "x", "y", "x2", "y2")

    def __init__(self, pages: P.Pages, k: int):
        import numpy as np

        read = pages.read(k, list(self.COLUMNS))
        self.columns = [read[c] for c in self.COLUMNS]
        _, _, x, y, x2, y2 = self.columns
        starts = np.arange(0, len(x), TILE)
        self.tiles = len(starts)
        self.low = [np.minimum.reduceat(np.minimum(*p), starts) for p in ((x, x2), (y, y2))]
        self.high = [np.maximum.reduceat(np.maximum(*p), starts) for p in ((x, x2), (y, y2))]

    def tile(self, t: int) -> list:
        return [c[t * TILE : (t + 1) * TILE] for c in self.columns]

    def near(self, other: Edges, t: int):
        """Tiles whose boxes meet that of the other's tile t."""
        import numpy as np

        met = [(self.low[k] <= other.high[k][t]) & (self.high[k] >= other.low[k][t]) for k in (0, 1)]
        return np.flatnonzero(met[0] & met[1])


def tile_crossings(a: list, b: list) -> int:
    """Pairs of an edge of a and one of b that cross and share no end."""
    import numpy as np

    s, t, *p = (c[:, None] for c in a)
    s2, t2, *q = (c[None, :] for c in b)
    turn = lambda e, x, y: np.sign((e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0]))
    cross = (turn(p, q[0], q[1]) * turn(p, q[2], q[3]) < 0) & (turn(q, p[0], p[1]) * turn(q, p[2], p[3]) < 0)
    return int((cross & (s != s2) & (s != t2) & (t != s2) & (t != t2)).sum())


def _between_stars(spark, stars: P.Pages) -> DataFrame:
    def run(batches):
        import numpy as np

        def page(k):
            got = stars.read(k, ["hub", "hx", "hy", "lx", "ly"])
            cut = np.flatnonzero(np.diff(got["hub"], prepend=-1, append=-1))
            return [((got["hx"][a], got["hy"][a]), (got["lx"][a:z], got["ly"][a:z])) for a, z in zip(cut[:-1], cut[1:], strict=True)]

        for task in P.numbers(batches):
            total, turn = 0, 0
            for k in range(len(stars.files)):
                mine = page(k)
                for m in range(k, len(stars.files)):
                    other = mine if m == k else page(m)
                    for i, a in enumerate(mine):
                        for b in other[i + 1 if m == k else 0 :]:
                            total += star_crossings(*a, *b) if turn % TASKS == task else 0
                            turn += 1
            yield from P.batches(n=np.array([total]))

    return P.tasks(spark, TASKS).mapInArrow(run, "n bigint")


def _between_tiles(spark, rest: P.Pages, stars: P.Pages | None) -> DataFrame:
    """Crossings among the edges of `rest`, and of these with edges of stars."""
    sources = [(rest, k) for k in range(len(rest.files))]
    others = sources + [(stars, k) for k in range(len(stars.files) if stars else 0)]

    def run(batches):
        import numpy as np

        for task in P.numbers(batches):
            total = 0
            for k, source in enumerate(sources):
                mine = Edges(*source)
                for m in range(k, len(others)):
                    other = mine if m == k else Edges(*others[m])
                    for t in range(task, mine.tiles, TASKS):
                        for u in other.near(mine, t):
                            if m != k or u > t:
                                total += tile_crossings(mine.tile(t), other.tile(u))
                            elif u == t:
                                total += tile_crossings(mine.tile(t), mine.tile(t)) // 2
            yield from P.batches(n=np.array([total]))

    return P.tasks(spark, TASKS).mapInArrow(run, "n bigint")


def crossings(edges: DataFrame, pos: DataFrame, cell: float, step: float | None) -> DataFrame:
    """One row: crossings of edges(src, dst, x, y, x2, y2) that share no end. An edge of a star is listed with its hub, others by tiles of like size and place."""
    spark, on = edges.sparkSession, lattice(pos, step)
    edges = settle(edges.filter("src <> dst").select("src", "dst", "x", "y", "x2", "y2"), "edges")
    stars = None
    if on and 2 * on.cells**2 < 1 << 26:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("idx")).groupBy("idx").agg(F.count("*").alias("n"))
        degree = lambda end: ends.select(F.col("idx").alias(end), F.col("n").alias("n_" + end))
        hub = edges.join(degree("src"), "src").join(degree("dst"), "dst").withColumn("out", F.expr("n_src > n_dst or (n_src = n_dst and src < dst)"))
        hub = settle(hub.withColumn("hub", F.when(F.col("out"), F.col("src")).otherwise(F.col("dst"))).drop("n_src", "n_dst"), "hubs")
        large = hub.groupBy("hub").agg(F.count("*").alias("n")).filter(F.col("n") >= STAR)
        starred, edges = hub.join(large.select("hub"), "hub", "left_semi"), hub.join(large.select("hub"), "hub", "left_anti")
        count = large.agg(F.sum("n")).first()[0] or 0
        if count:
            at = [F.when(F.col("out") == way, on.cell(c)).otherwise(on.cell(c + "2")) for way in (True, False) for c in "xy"]
            names = ("hx", "hy", "lx", "ly")
            stars = P.store(starred.select("hub", "src", "dst", "x", "y", "x2", "y2", *(v.alias(k) for k, v in zip(names, at, strict=True))), "hub", count, "stars")
    wide = F.greatest(F.abs(F.col("x") - F.col("x2")), F.abs(F.col("y") - F.col("y2")), F.lit(cell))
    size = F.ceil(F.log2(wide / cell))
    strip = lambda c: F.pmod(F.floor((F.col(c) + F.col(c + "2")) / 2 / (cell * F.pow(F.lit(2.0), size))), F.lit(1 << 26)).cast("long")
    rest = edges.select("src", "dst", "x", "y", "x2", "y2", F.shiftleft(size.cast("long"), 52).bitwiseOR(F.shiftleft(strip("x"), 26)).bitwiseOR(strip("y")).alias("place"))
    rest = P.store(rest, "place", max(1, edges.count()), "edges")
    parts = []
    if stars:
        parts.append(_between_stars(spark, stars))
    if rest.rows:
        parts.append(_between_tiles(spark, rest, stars))
    counted = parts[0] if parts else spark.range(0).select(F.col("id").alias("n"))
    for more in parts[1:]:
        counted = counted.unionAll(more)
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("crossings"))


def _smooth(n: int) -> int:
    """The least number from n on without a prime factor above 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def each_distance(a, b, weight) -> tuple[float, float]:
    """Sums of weight * distance and of (weight * distance)^2 over all pairs of a place in a and one in b, which has the weight."""
    import numpy as np

    total = own = 0.0
    for m in range(0, len(weight), 1 << 16):
        w, there = weight[m : m + (1 << 16)], [q[m : m + (1 << 16)] for q in b]
        rows = max(1, (1 << 18) // len(w))
        for k in range(0, len(a[0]), rows):
            r2 = sum((p[k : k + rows, None] - q[None, :]) ** 2 for p, q in zip(a, there, strict=True)).astype(float)
            own += float((r2 @ (w * w)).sum())
            total += float((np.sqrt(r2) @ w).sum())
    return total, own


class Convolution:
    """The sums of each_distance over places on a lattice of so many cells a side, block by block of the lattice."""

    def __init__(self, cells: int):
        self.cells, self.side = cells, min(cells, SIDE)
        self.size, self.kernel = _smooth(2 * self.side), (None, None)

    def cost(self, a, b) -> int:
        """As many pairs of each_distance take about as long."""
        return 16 * self.size**2 * min(len(a[0]), -(-self.cells // self.side) ** 2) * min(len(b[0]), -(-self.cells // self.side) ** 2)

    def _blocks(self, x, y):
        import numpy as np

        of = (x // self.side) * (1 << 32) + y // self.side
        order = np.argsort(of, kind="stable")
        cut = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            yield divmod(int(of[order[a]]), 1 << 32), order[a:z]

    def _waves(self, x, y, weight):
        import numpy as np

        spots = np.bincount((x % self.side) * self.side + y % self.side, weight, self.side**2).reshape(self.side, self.side)
        return np.fft.rfft2(spots, (self.size, self.size))

    def _distance(self, dx: int, dy: int):
        """Waves of the distance from the origin over the moves between two blocks that are so many blocks apart."""
        import numpy as np

        if self.kernel[0] != (dx, dy):
            move = np.arange(self.size)
            move = np.where(move < self.side, move, move - self.size)
            self.kernel = None, None
            self.kernel = (dx, dy), np.fft.rfft2(np.hypot((move + dx * self.side)[:, None], (move + dy * self.side)[None, :]))
        return self.kernel[1]

    def sums(self, a, b, weight) -> tuple[float, float]:
        import numpy as np

        total, twice = 0.0, np.full(self.size // 2 + 1, 2.0)
        twice[0] = 1
        if self.size % 2 == 0:
            twice[-1] = 1
        for (i, j), here in self._blocks(*a):
            mine = self._waves(a[0][here], a[1][here], None)
            for (k, m), there in self._blocks(*b):
                waves = self._waves(b[0][there], b[1][there], weight[there])
                np.conj(waves, out=waves)
                waves *= mine
                waves *= self._distance(k - i, m - j)
                total += float((waves.real @ twice).sum()) / self.size**2
        own, n, w2 = 0.0, len(a[0]), weight * weight
        for p, q in zip(a, b, strict=True):
            own += float((p * p).sum()) * float(w2.sum()) + n * float((w2 * (q * q)).sum()) - 2 * float(p.sum()) * float((w2 * q).sum())
        return total, own


def _reached(at, dst, depth, source: int):
    """Nodes in reach of the source by hops, and their hops; depth is -1 everywhere, before and after."""
    import numpy as np

    front, found = np.array([source]), []
    while len(front):
        depth[front] = len(found)
        found.append(front)
        near = dst[P.spread(at[front], at[front + 1] - at[front])]
        front = np.unique(near[depth[near] < 0])
    nodes = np.concatenate(found)
    hops = depth[nodes]
    depth[nodes] = -1
    return nodes, hops


def stress_sums(g: Graph, pos: DataFrame, step: float | None) -> DataFrame:
    """Rows (pairs, total, own) to be added up: ordered pairs in reach, and over them the sums of distance / hops and of its square.

    Tasks share the nodes as sources. A node with a single neighbour, the leaf of a node that has more, is as far from any
    other node as that node and one hop more, so leaves are no sources. A task holds 40 bytes a node, or 32 on a
    lattice, and four a link.
    """
    n, on = g.nodes.count(), lattice(pos, step)
    links = P.links(g.adjacency(), 2 * g.edges.count())
    at_cell = [on.cell(c).cast("int").alias(c) for c in "xy"] if on else [F.col(c).cast("double").alias(c) for c in "xyz"]
    places = P.store(pos.select("idx", *at_cell), "idx", max(1, n), "places")
    names, scale = ("xy", on.step) if on else ("xyz", 1.0)

    def run(batches):
        import numpy as np

        at, dst = P.whole(links, n, True)
        count = np.diff(at)
        owner = np.full(n, -1, np.int32)
        single = np.flatnonzero(count == 1)
        single = single[count[dst[at[single]]] > 1]
        owner[single] = dst[at[single]]
        cores = np.flatnonzero((count > 0) & (owner < 0))
        placed, where = np.zeros(n, bool), [np.zeros(n, np.int32 if on else float) for _ in names]
        for k in range(len(places.files)):
            read = places.read(k, ["idx", *names])
            placed[read["idx"]] = True
            for c, v in zip(names, where, strict=True):
                v[read["idx"]] = read[c]
        depth, wave = np.full(n, -1, np.int32), Convolution(on.cells) if on else None
        for task in P.numbers(batches):
            pairs, total, own = 0, 0.0, 0.0
            for core in cores[task::TASKS]:
                nodes, hops = _reached(at, dst, depth, int(core))
                kept = placed[nodes]
                nodes, hops = nodes[kept], hops[kept]
                leaves = dst[at[core] : at[core + 1]]
                leaves = leaves[(owner[leaves] == core) & placed[leaves]]
                pairs += (int(placed[core]) + len(leaves)) * (len(nodes) - 1)
                target = [v[nodes].astype(np.int64 if on else float) for v in where]
                for sources, weight in ((np.array([core])[placed[core : core + 1]], 1.0 / np.maximum(hops, 1)), (leaves, 1.0 / (hops + 1.0))):
                    if len(sources) and len(nodes):
                        mine = [v[sources].astype(np.int64 if on else float) for v in where]
                        fast = wave and wave.cost(mine, target) < len(sources) * len(nodes)
                        got = wave.sums(mine, target, weight) if fast else each_distance(mine, target, weight)
                        total, own = total + got[0] * scale, own + got[1] * scale * scale
            if pairs:
                yield from P.batches(pairs=np.array([pairs]), total=np.array([total]), own=np.array([own]))

    return P.tasks(g.nodes.sparkSession, TASKS).mapInArrow(run, "pairs bigint, total double, own double")
