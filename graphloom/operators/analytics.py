"""Graph metrics as DataFrame programs: each round of an iteration is joins and partial aggregates, stored before the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, dense_index
from ..plans.tables import settle
from . import pages as P

#: Rounds between stored tables in loops whose every round is cheap.
STORE_EVERY = 5


def degrees(g: Graph) -> DataFrame:
    """idx, degree, indegree, outdegree; each occurrence of an edge counts, a self loop once in and once out."""
    ends = g.edges.select(F.col("src").alias("idx"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(g.edges.select(F.col("dst").alias("idx"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("idx").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return g.nodes.select("idx").join(sums, "idx", "left").select("idx", (zero("indegree") + zero("outdegree")).alias("degree"), zero("indegree").alias("indegree"), zero("outdegree").alias("outdegree"))


def pagerank(g: Graph, damping: float = 0.85, iterations: int = 50, symmetric: bool = False) -> DataFrame:
    """idx, pagerank: fixed rounds from 1/n; each edge occurrence carries a share, dangling mass goes to all nodes evenly."""
    edges = settle((g.adjacency() if symmetric else g.edges.select("src", "dst")).groupBy("src", "dst").agg(F.count("*").alias("k")), "links")
    n = g.nodes.count()
    if not n:
        return g.nodes.select("idx", F.lit(0.0).alias("pagerank"))
    out = edges.groupBy(F.col("src").alias("idx")).agg(F.sum("k").alias("out"))
    links = edges.join(out.withColumnRenamed("idx", "src"), "src").select("src", "dst", (F.col("k") / F.col("out")).alias("share"))
    links = settle(links, "shares")
    nodes = settle(g.nodes.select("idx").join(out, "idx", "left"), "outs")
    rank = nodes.withColumn("pagerank", F.lit(1.0 / n)) if (dangling := nodes.filter("out is null").limit(1).count()) else nodes.select("idx", F.lit(1.0 / n).alias("pagerank"))
    every = nodes.select("idx", F.lit(0.0).alias("given"))
    for step in range(iterations):
        given = links.join(rank.select(F.col("idx").alias("src"), "pagerank"), "src").select(F.col("dst").alias("idx"), (F.col("share") * F.col("pagerank")).alias("given"))
        given = given.unionAll(every).groupBy("idx").agg(F.sum("given").alias("given"))
        new = (1 - damping) / n + damping * F.col("given")
        if dangling:
            lost = rank.filter("out is null").agg(F.sum("pagerank").alias("lost"))
            rank = given.join(nodes, "idx").crossJoin(F.broadcast(lost)).select("idx", "out", (new + damping * F.col("lost") / n).alias("pagerank"))  # one row
        else:
            rank = given.select("idx", new.alias("pagerank"))
        if step % STORE_EVERY == STORE_EVERY - 1:
            rank = settle(rank, "rank")
    return rank.select("idx", "pagerank")


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    near = edges if small else edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = near.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    joined = near.join(least, "src")
    if small:
        out = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionAll(least.select("src", F.col("m").alias("dst")))
    else:
        out = joined.filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return out.filter("src <> dst").distinct()


def components(g: Graph) -> DataFrame:
    """idx, component: the least idx of the weakly connected component; by alternating stars, in logarithmically many rounds."""
    edges = settle(g.edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src <> dst").distinct(), "stars")
    state = None
    while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())) != state and now[0]:
        state = now
        edges = settle(_stars(_stars(edges, False), True), "stars")
    roots = edges.select(F.col("src").alias("idx"), F.col("dst").alias("root"))
    return g.nodes.select("idx").join(roots, "idx", "left").select("idx", F.coalesce("root", "idx").alias("component"))


def first_seen(labels: DataFrame, label: str, out: str) -> DataFrame:
    """Number labels from 0 in the order of their first idx, sorted by ranges: there may be as many labels as nodes."""
    firsts = labels.groupBy(label).agg(F.min("idx").alias("_first"))
    ranked = dense_index(firsts, "_first").select(label, F.col("idx").cast("long").alias(out))
    return labels.join(ranked, label).select("idx", out)


def wcc(g: Graph) -> DataFrame:
    return first_seen(components(g), "component", "wcc")


def bfs(g: Graph, source: int, most: int | None = None) -> DataFrame:
    """idx, distance in hops over undirected edges; null if out of reach (or beyond `most` hops)."""
    near = settle(g.neighbours(), "near")
    seen = g.nodes.select("idx").filter(F.col("idx") == source).withColumn("distance", F.lit(0))
    front, hop = seen, 0
    while front.limit(1).count() and hop != most:
        hop += 1
        reached = near.join(front.select(F.col("idx").alias("src")), "src", "left_semi").select(F.col("dst").alias("idx")).distinct()
        front = settle(reached.join(seen, "idx", "left_anti").withColumn("distance", F.lit(hop)), "front")
        seen = seen.unionAll(front)
        if hop % 20 == 0:
            seen = settle(seen, "seen")
    return g.nodes.select("idx").join(seen, "idx", "left")


def _dependencies(near: P.Reader, n: int, sources):
    """Brandes' sums of the sources over all nodes, a source at a time; nodes at one distance are taken together."""
    import numpy as np

    total, slot = np.zeros(n), np.zeros(n, np.int64)
    for s in sources:
        hops, sigma, part = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
        hops[s], sigma[s] = 0, 1.0
        levels = [np.array([s])]
        while len(levels[-1]):
            front, hop, found = levels[-1], len(levels), []
            for at, dst in near.near(front):
                new = hops[dst]
                fits = (new < 0) | (new == hop)
                dst, fresh = dst[fits], dst[new < 0]
                np.add.at(sigma, dst, sigma[front[at[fits]]])
                hops[fresh] = hop
                slot[fresh] = np.arange(len(fresh))
                found.append(fresh[slot[fresh] == np.arange(len(fresh))])
            levels.append(np.sort(np.concatenate(found)).astype(np.int64) if found else np.empty(0, np.int64))
        # A node's share (1 + delta) / sigma is set once its level is done, so neighbours that are no further away count as 0.
        for front in reversed(levels):
            delta = np.zeros(len(front))
            for at, dst in near.near(front):
                low = at[0] if len(at) else 0
                sums = np.bincount(at - low, part[dst])
                delta[low : low + len(sums)] += sums
            delta *= sigma[front]
            part[front] = (1 + delta) / sigma[front]
            if len(front) and front[0] != s:
                total[front] += delta
    return total


def betweenness(g: Graph, k: int = 500) -> DataFrame:
    """idx, betweenness by Brandes from the first min(k, n) nodes at once; parallel edges count, sums are not halved.

    Tasks share the sources and read pages of links, so nothing is stored per pair of nodes; a task holds 36 bytes a node.
    """
    n = g.nodes.count()
    links = P.links(g.adjacency(), 2 * g.edges.count())
    count, many = min(k, n), min(k, n, 32)

    def run(batches):
        import numpy as np

        for t in P.numbers(batches):
            total = _dependencies(P.Reader(links), n, range(t, count, many))
            kept = np.flatnonzero(total)
            yield from P.batches(idx=kept, betweenness=total[kept])

    none = g.nodes.select("idx", F.lit(0.0).alias("betweenness"))
    if not count or not links.rows:
        return none
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / count)
    sums = P.tasks(g.nodes.sparkSession, many).mapInArrow(run, "idx bigint, betweenness double")
    return sums.unionAll(none).groupBy("idx").agg((F.sum("betweenness") * scale).alias("betweenness"))


def core_numbers(g: Graph) -> DataFrame:
    """idx, core: true core numbers of the simple graph, as the limit of h-indices of neighbours' estimates."""
    near = settle(g.neighbours(), "near")
    core = settle(g.nodes.select("idx").join(near.groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("core")), "idx", "left").select("idx", F.coalesce("core", F.lit(0)).alias("core")), "core")
    while True:
        # Counts by neighbour value suffice for the h-index: a hub's neighbours are summed before they meet.
        mine = core.select(F.col("idx").alias("src"), F.col("core").alias("own"))
        seen = near.join(core.select(F.col("idx").alias("dst"), "core"), "dst").join(mine, "src").groupBy("src", F.least("core", "own").alias("v")).agg(F.count("*").alias("n"))
        above = Window.partitionBy("src").orderBy(F.desc("v"))
        h = seen.withColumn("c", F.sum("n").over(above)).groupBy(F.col("src").alias("idx")).agg(F.max(F.least("v", "c")).alias("h"))
        new = settle(core.join(h, "idx", "left").select("idx", F.least("core", F.coalesce("h", F.lit(0))).alias("core")), "core")
        if not new.join(core.withColumnRenamed("core", "was"), "idx").filter("core <> was").limit(1).count():
            return new
        core = new


def _sweep_core(n: int, at, dst):
    """Only nodes with a neighbour that fell since their last visit are counted again: the others would stay."""
    import numpy as np

    core, due = np.diff(at), np.ones(n, bool)
    while due.any():
        for v in range(n):
            if not due[v]:
                continue
            due[v] = False
            near = dst[at[v] : at[v + 1]]
            kept = np.count_nonzero(core[near] >= core[v])
            if kept < core[v]:
                core[v] = kept
                due[near] = True
    return core


def sequential(g: Graph, solve, name: str, distinct: bool = False) -> DataFrame:
    """idx, name: run an algorithm whose result depends on the order of its steps in one task, which holds four bytes for each end of an edge.

    solve(n, at, dst) gives a value for each node; the links of node v, in both directions and with self loops twice, are
    dst[at[v]:at[v + 1]] in ascending order.
    """
    n = g.nodes.count()
    e = g.edges.select("src", "dst")
    links = P.links(e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), 2 * e.count())

    def run(batches):
        import numpy as np

        for _ in P.numbers(batches):
            yield from P.batches(idx=np.arange(n), **{name: np.asarray(solve(n, *P.whole(links, n, distinct)), np.int64)})

    return P.tasks(g.nodes.sparkSession, 1).mapInArrow(run, f"idx bigint, {name} bigint")


def kcore_sweep(g: Graph) -> DataFrame:
    """idx, kcore: sweeps in index order, in place, from degrees that count parallel edges and self loops."""
    return sequential(g, _sweep_core, "kcore")


def label_propagation(g: Graph, passes: int = 10) -> DataFrame:
    """idx, label: each round the most frequent label of neighbours, least on ties; isolated nodes keep their own."""
    near = settle(g.adjacency(), "near")
    labels = g.nodes.select("idx", F.col("idx").alias("label"))
    for _ in range(passes):
        votes = near.join(labels.select(F.col("idx").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("src").alias("idx")).agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b"))
        labels = settle(labels.join(best, "idx", "left").select("idx", F.coalesce(-F.col("b.l"), F.col("label")).alias("label")), "labels")
    return first_seen(labels, "label", "label_id").withColumnRenamed("label_id", "label")


def louvain(g: Graph, rounds: int = 10, moves: int = 12) -> DataFrame:
    """idx, community: synchronous local moving by modularity gain, then aggregation, until nothing moves.

    In each pass nodes of one random half move at a time, so that neighbours do not swap communities for ever.
    """
    spark = g.nodes.sparkSession
    links = settle(g.adjacency().groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), "links")
    whole = settle(g.nodes.select("idx", F.col("idx").alias("community")), "community")
    loops = spark.createDataFrame([], "node bigint, w double")
    twice_m = links.agg(F.sum("w")).first()[0]
    if not twice_m:
        return first_seen(whole, "community", "c").withColumnRenamed("c", "community")
    for level in range(rounds):
        strength = settle(links.select(F.col("src").alias("node"), "w").unionAll(loops.select("node", "w")).groupBy("node").agg(F.sum("w").alias("k")), "strength")
        place = settle(strength.select("node", F.col("node").alias("c")), "place")
        moved_any = False
        for step in range(moves):
            tot = place.join(strength, "node").groupBy("c").agg(F.sum("k").alias("tot"))
            into = links.filter("src <> dst").join(place.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("k_in"))
            own = place.withColumnRenamed("c", "old").join(strength, "node")
            gain = F.col("k_in") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0.0)) / twice_m
            rated = into.unionAll(place.select("node", "c", F.lit(0.0).alias("k_in"))).groupBy("node", "c").agg(F.sum("k_in").alias("k_in")).join(tot, "c").join(own, "node").withColumn("gain", gain)
            best = rated.groupBy("node", "old").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("b"), F.max(F.when(F.col("c") == F.col("old"), F.col("gain"))).alias("stay"))
            turn = F.pmod(F.xxhash64("node", F.lit(level * 100 + step)), F.lit(2)) == 0
            new = settle(best.select("node", F.when(turn & (F.col("b.gain") > F.col("stay") + 1e-9), -F.col("b.c")).otherwise(F.col("old")).alias("c"), "old"), "place")
            moved = new.filter("c <> old").count()
            place, moved_any = new.select("node", "c"), moved_any or moved > 0
            if not moved and step % 2:
                break
        if not moved_any:
            break
        at = lambda col, name: place.select(F.col("node").alias(col), F.col("c").alias(name))
        up = links.join(at("src", "s"), "src").join(at("dst", "d"), "dst").groupBy("s", "d").agg(F.sum("w").alias("w"))
        up = settle(up.select(F.col("s").alias("src"), F.col("d").alias("dst"), "w"), "links")
        loops = settle(loops.join(place, "node").select(F.col("c").alias("node"), "w").unionAll(up.filter("src = dst").select(F.col("src").alias("node"), "w")).groupBy("node").agg(F.sum("w").alias("w")), "loops")
        links = settle(up.filter("src <> dst"), "links")
        whole = settle(whole.join(place.select(F.col("node").alias("community"), "c"), "community", "left").select("idx", F.coalesce("c", "community").alias("community")), "community")
    return first_seen(whole, "community", "c").withColumnRenamed("c", "community")


def modularity(g: Graph, communities: DataFrame) -> DataFrame:
    """One row: modularity of idx, community over the graph without self loops."""
    links = g.adjacency()
    at = lambda col, name: communities.select(F.col("idx").alias(col), F.col("community").alias(name))
    by = links.join(at("src", "s"), "src").join(at("dst", "d"), "dst")
    sums = by.groupBy(F.col("s").alias("c")).agg(F.count("*").cast("double").alias("tot"), F.count_if(F.col("s") == F.col("d")).cast("double").alias("inside"))
    whole = links.agg(F.count("*").cast("double").alias("m2"))
    return sums.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("tot") / F.col("m2"), 2)).alias("modularity"))


def _closed(links: P.Pages, k: int, n: int):
    """Arrays edge, x, w, t, du, dv for the links x to w of page k, taken from their end of higher degree: common neighbours and degrees of both ends.

    All pages pass by. A node of page k marks its neighbours, and the lists of those in the page at hand are looked up, so
    a wedge is closed from its end of lower degree, which bounds the work at hubs.
    """
    import numpy as np

    own, rows = P.Links(links, k, True), links.read(k, ["link", "edge"])
    new = np.concatenate(([True], rows["link"][1:] != rows["link"][:-1]))
    link, place = rows["link"][new], np.cumsum(new) - 1
    x, w, sizes = link >> 32, link & 0xFFFFFFFF, np.diff(own.at)
    du, mark = sizes[x - own.first], np.zeros(n, bool)
    for j in range(len(links.files)):
        here = np.flatnonzero((w >= links.files[j][1] >> 32) & (w <= links.files[j][2] >> 32))
        if not len(here):
            continue
        page = own if j == k else P.Links(links, j, True)
        dv = np.diff(page.at)[w[here] - page.first]
        low = (dv < du[here]) | ((dv == du[here]) & (w[here] < x[here]))
        here, dv = here[low], dv[low]
        if not len(here):
            continue
        starts, t = page.at[w[here] - page.first], np.empty(len(here), np.int64)
        cuts = np.append(np.flatnonzero(np.diff(x[here], prepend=-1)), len(here))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            node = x[here[a]] - own.first
            near = own.dst[own.at[node] : own.at[node + 1]]
            mark[near] = True
            hits = np.concatenate(([0], np.cumsum(mark[page.dst[P.spread(starts[a:z], dv[a:z])]])))
            ends = np.cumsum(dv[a:z])
            t[a:z] = hits[ends] - hits[ends - dv[a:z]]
            mark[near] = False
        back = np.full(len(link), -1)
        back[here] = np.arange(len(here))
        kept = np.flatnonzero(back[place] >= 0)
        pick = back[place[kept]]
        yield rows["edge"][kept], x[here[pick]], w[here[pick]], t[pick], du[here[pick]], dv[pick]


def edge_strength(g: Graph, mode: str = "jaccard") -> DataFrame:
    """eidx, src, dst, strength by common neighbours of the simple graph: jaccard, or overlap corrected by the largest count.

    Tasks take a page of links each and read the others, so no wedge is stored; a task holds two pages and a byte a node.
    """
    n, e = g.nodes.count(), g.edges.filter("src <> dst")
    both = e.select("src", "dst", (F.col("eidx") * 2).alias("edge")).unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("eidx") * 2 + 1))
    links = P.links(both, 2 * g.edges.count(), "edge")

    def run(batches):
        import numpy as np

        for k in P.numbers(batches):
            for edge, x, w, t, du, dv in _closed(links, k, n):
                turned = (edge & 1).astype(bool)
                yield from P.batches(eidx=edge >> 1, src=np.where(turned, w, x), dst=np.where(turned, x, w), t=t, du=du, dv=dv)

    loops = g.edges.filter("src = dst").select("eidx", "src", "dst", F.lit(0.0).alias("strength"))
    if not links.files:
        return loops
    counted = P.tasks(g.nodes.sparkSession, len(links.files)).mapInArrow(run, "eidx bigint, src bigint, dst bigint, t bigint, du bigint, dv bigint")
    if mode == "jaccard":
        below = F.col("du") - 1 + F.col("dv") - 1 - F.col("t")
        rated = counted
    else:
        rated = counted.crossJoin(F.broadcast(counted.agg(F.max("t").alias("mu"))))  # one row
        below = F.col("mu") + F.greatest("du", "dv") - 1 - F.col("t")
    value = F.when(below > 0, F.least(F.greatest(F.col("t") / below, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return rated.select("eidx", "src", "dst", value.alias("strength")).unionAll(loops)


def rest_length(strength: Column, base: float = 1.0, spread: float = 1.0) -> Column:
    return base * (1 + spread * (1 - strength))


def spmv(matrix: DataFrame, x: DataFrame, half: bool = False) -> DataFrame:
    """row, y = sum of w * x over matrix(row, col, w) and x(col, x); weights first rounded to half precision if asked."""
    if half:
        from ..functions.numeric import to_half

        matrix = matrix.withColumn("w", to_half(F.col("w")))
    return matrix.join(x, "col").groupBy("row").agg(F.sum(F.col("w") * F.col("x")).alias("y"))


def compute_all(g: Graph, k: int = 500) -> DataFrame:
    """All metrics of the nodes by idx; core numbers are the true ones, which graphs of any size have."""
    out = degrees(g)
    for part in (pagerank(g), betweenness(g, k), core_numbers(g), wcc(g), louvain(g)):
        out = settle(out.join(part, "idx"), "metrics")
    return out


def summary(metrics: DataFrame, g: Graph) -> DataFrame:
    edges = g.edges.agg(F.count("*").alias("n_edges"))
    return metrics.agg(F.count("*").alias("n_nodes"), F.countDistinct("wcc").alias("num_wcc"), F.countDistinct("community").alias("num_communities")).crossJoin(F.broadcast(edges))


def boundary(g: Graph, owners: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ghosts (part, idx), boundary nodes (part, idx) and the edge cut for owners(idx, part)."""
    at = lambda col, name: owners.select(F.col("idx").alias(col), F.col("part").alias(name))
    cross = g.neighbours().join(at("src", "a"), "src").join(at("dst", "b"), "dst").filter("a <> b")
    return cross.select(F.col("a").alias("part"), F.col("dst").alias("idx")).distinct(), cross.select(F.col("a").alias("part"), F.col("src").alias("idx")).distinct(), cross.filter("src < dst").agg(F.count("*").alias("edge_cut"))
