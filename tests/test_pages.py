"""Operators that read links as pages of arrays."""

import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph, from_pairs
from graphloom.operators import analytics as A
from graphloom.operators import forces, generators, layout, measures, pages, pairs, partition
from graphloom.plans.tables import shared_dir


def stored(spark):
    folder = shared_dir(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_pages_are_cut_between_nodes(spark):
    pairs = sorted({(random.Random(k).randrange(40), k % 50) for k in range(400)})
    cut = pages.store(from_pairs(spark, 50, pairs).edges.select((F.col("src") * (1 << 32) + F.col("dst")).alias("link")), "link", len(pairs), "links", 40)
    assert len(cut.files) > 3 and cut.rows == len(pairs)
    at, dst = pages.whole(cut, 50)
    assert [(v, int(w)) for v in range(50) for w in dst[at[v] : at[v + 1]]] == pairs


def brandes(n, pairs, k):
    near = [[] for _ in range(n)]
    for s, t in pairs:
        if s != t:
            near[s].append(t)
            near[t].append(s)
    out = [0.0] * n
    for s in range(min(k, n)):
        hops, sigma, order, queue = {s: 0}, [0.0] * n, [], deque([s])
        sigma[s] = 1.0
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in hops:
                    hops[w] = hops[v] + 1
                    queue.append(w)
                if hops[w] == hops[v] + 1:
                    sigma[w] += sigma[v]
        delta = [0.0] * n
        for w in reversed(order):
            for v in near[w]:
                if hops[v] == hops[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            out[w] += delta[w] * (w != s)
    return [x / ((n - 1) * (n - 2)) * n / min(k, n) for x in out]


def test_betweenness_of_links_and_loops(spark):
    r = random.Random(4)
    pairs = [(r.randrange(25), r.randrange(25)) for _ in range(60)] + [(30, 31), (31, 32), (31, 32), (33, 33)]
    got = {x.idx: x.betweenness for x in A.betweenness(from_pairs(spark, 35, pairs), 12).collect()}
    assert [got[v] for v in range(35)] == pytest.approx(brandes(35, pairs, 12))
    assert {x.betweenness for x in A.betweenness(from_pairs(spark, 3, [])).collect()} == {0.0}


def test_betweenness_stores_nothing_per_level(spark):
    g, before = generators.path(spark, 12), stored(spark)
    assert A.betweenness(g).count() == 12
    assert len(stored(spark) - before) == 1  # the links


@pytest.fixture(scope="module")
def wide(spark):
    """A ring of 1,000 nodes with 2,001 edges between neighbours, in the order of rounds."""
    edges = spark.range(2_001_000).select(F.col("id").alias("eidx"), (F.col("id") % 1000).alias("src"), ((F.col("id") + 1) % 1000).alias("dst"))
    return Graph(spark.range(1000).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("id")), edges)


def test_kcore_sweep_of_many_edges(spark, wide):
    assert {(r.kcore, r["count"]) for r in A.kcore_sweep(wide).groupBy("kcore").count().collect()} == {(4002, 1000)}


def test_kcore_sweep_counts_again_what_may_fall(spark):
    r = random.Random(7)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(200)]
    near = [[] for _ in range(60)]
    for s, t in pairs:
        near[s].append(t)
        near[t].append(s)
    core, moved = [len(x) for x in near], True
    while moved:
        moved = False
        for v in range(60):
            kept = sum(core[w] >= core[v] for w in near[v])
            if kept < core[v]:
                core[v], moved = kept, True
    got = {x.idx: x.kcore for x in A.kcore_sweep(from_pairs(spark, 60, pairs)).collect()}
    assert [got[v] for v in range(60)] == core


def test_first_touch_of_many_edges(spark, wide):
    assert {r.idx: r.part for r in partition.first_touch(wide).collect()} == {v: v // 2 for v in range(1000)}


def test_refined_of_many_edges(spark, wide):
    halves = wide.nodes.select("idx", F.when((F.col("idx") < 500) == (F.col("idx") != 250), 0).otherwise(1).cast("long").alias("part"))
    got = {r.idx: r.part for r in partition.refined(wide, halves, 2).collect()}
    assert got == {v: int(v >= 500) for v in range(1000)} or sum(got[v] != got[(v + 1) % 1000] for v in range(1000)) == 2
    with pytest.raises(Exception, match="no part"):
        partition.refined(wide, halves.filter("idx > 3"), 2).collect()


def test_regions_of_many_edges(spark, wide):
    got = {r.idx: r.part for r in partition.regions(wide, 4).collect()}
    assert {v for v in got if got[v] == 0} == {*range(126), *range(876, 1000)}
    assert [list(got.values()).count(p) for p in range(4)] == [250] * 4


def test_exact_forces_store_no_pairs(spark):
    r, before = random.Random(3), stored(spark)
    rows = [(i, r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(1, 4)) for i in range(90)] + [(90, 1.0, 1.0, 1.0, 2.0), (91, 1.0, 1.0, 1.0, 2.0)]
    points = spark.createDataFrame(rows, "idx bigint, x double, y double, z double, mass double")
    for added, power in ((False, 1.0), (True, 1.0), (False, 1.5)):
        got = {x.idx: (x.fx, x.fy, x.fz) for x in forces.far_field(points, 0.0, least=0.5, added=added, power=power).collect()}
        for i, *p, _ in rows:
            want = [0.0] * 3
            for j, *q, m in rows:
                if i != j:
                    r2 = sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
                    below = (r2 + 0.5 if added else max(r2, 0.5)) ** power
                    want = [v + m * (a - b) / below for v, a, b in zip(want, p, q, strict=True)]
            assert got[i] == pytest.approx(want, abs=1e-9)
    assert len(stored(spark) - before) == 3  # the points, each time


def crossed(places, edges):
    """Pairs of edges that cross, one with one."""
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    met = 0
    for k, (a, b) in enumerate(edges):
        for c, d in edges[:k]:
            p, q, r, s = (places[v] for v in (a, b, c, d))
            met += len({a, b, c, d}) == 4 - (a == b) - (c == d) and turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0
    return met


def hubs(seed, n, at):
    """Edges of two nodes with many, of one with few and between any, and the places of all nodes."""
    r = random.Random(seed)
    edges = [(3, r.randrange(n)) for _ in range(90)] + [(r.randrange(n), 8) for _ in range(70)] + [(5, r.randrange(n)) for _ in range(9)] + [(r.randrange(n), r.randrange(n)) for _ in range(30)]
    return edges, [at(r) for _ in range(n)]


@pytest.mark.parametrize("step", [2.5, None, "none fits"])
def test_crossings_store_no_pairs(spark, step):
    cell = (lambda r: (2.5 * r.randrange(12) - 7, 2.5 * r.randrange(9) + 1, 4.0)) if step == 2.5 or step is None else (lambda r: (r.uniform(-9, 9), r.uniform(-9, 9), 0.0))
    edges, places = hubs(6, 60, cell)
    pos = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "idx bigint, x double, y double, z double")
    assert (pairs.lattice(pos, 2.5) is None) == (step == "none fits")
    before = stored(spark)
    got = layout.crossings(from_pairs(spark, 60, edges), pos, 0.5, 2.5 if step else None).collect()
    assert [tuple(x) for x in got] == [(crossed(places, edges),)] and got[0][0] > 1000
    assert len(stored(spark) - before) == (4 if step == 2.5 else 2)  # the edges by size and place, and those of hubs


def test_crossings_of_hubs_with_many_edges(spark):
    """Two hubs below a row of 5,000 nodes, whose 3 million crossings would be as many rows."""
    n = 2500
    nodes = spark.range(2 * n + 2).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("id"))
    edges = spark.range(2 * n).select(F.col("id").alias("eidx"), F.col("id").alias("src"), (F.col("id") % 2 + 2 * n).alias("dst"))
    pos = nodes.select("idx", F.when(F.col("idx") < 2 * n, F.col("idx")).otherwise((F.col("idx") - 2 * n) * 2 * n).cast("double").alias("x"), F.when(F.col("idx") < 2 * n, 3.0).otherwise(0.0).alias("y"), F.lit(0.0).alias("z"))
    before = stored(spark)
    assert layout.crossings(Graph(nodes, edges), pos, 1.0, 1.0).first()[0] == n * (n - 1) // 2
    assert len(stored(spark) - before) == 4


def test_tiles_are_compared_where_their_boxes_meet(spark):
    r = random.Random(2)
    rows = [(2 * k, r.uniform(0, 60), r.uniform(0, 60)) for k in range(1500)]
    rows += [(i + 1, x + r.uniform(-3, 3) * (60 if i % 50 == 0 else 1), y + r.uniform(-3, 3)) for i, x, y in rows]
    places = {i: (x, y) for i, x, y in rows}
    pos = spark.createDataFrame([(i, x, y, 0.0) for i, x, y in rows], "idx bigint, x double, y double, z double")
    edges = [(k, k + 1) for k in range(0, 3000, 2)]
    assert layout.crossings(from_pairs(spark, 3000, edges), pos, 1.0).first()[0] == crossed(places, edges)


@pytest.mark.parametrize("step", [2.5, None])
def test_stress_stores_no_pairs(spark, step):
    edges, places = hubs(5, 60, lambda r: (2.5 * r.randrange(12) - 7, 2.5 * r.randrange(9) + 1, 4.0 if step else r.uniform(0, 9)))
    edges = edges[:40] + edges[100:130] + [(60, 61), (62, 62), (62, 63), (64, 63), (63, 64)]
    places += [(0.5, 3.5 + 2.5 * k, 4.0) for k in range(6)]
    g = from_pairs(spark, 66, edges)
    pos = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "idx bigint, x double, y double, z double")
    met = [(x.d, sum((a - b) ** 2 for a, b in zip(places[x.s], places[x.idx], strict=True)) ** 0.5) for x in measures.hop_pairs(g).collect() if x.s < x.idx]
    want = layout.stress(spark.createDataFrame(met, "d int, apart double")).first()[0]
    before = stored(spark)
    got = measures.all_pairs_stress(g, pos, step).first()
    assert (got["pairs"], got["stress"]) == (len(met), pytest.approx(want, abs=1e-12))
    assert len(stored(spark) - before) == 2  # links and places


@pytest.mark.parametrize("side", [1024, 7])
def test_distances_by_convolution(side, monkeypatch):
    import numpy as np

    monkeypatch.setattr(pairs, "SIDE", side)
    r = np.random.default_rng(1)
    a, b, w = r.integers(0, 30, (2, 50)), r.integers(0, 30, (2, 80)), r.uniform(0, 1, 80)
    assert pairs.Convolution(30).sums(a, b, w) == pytest.approx(pairs.each_distance(a, b, w), rel=1e-12)


@pytest.mark.parametrize("mode", ["jaccard", "corrected"])
def test_edge_strength_stores_no_wedges(spark, mode, monkeypatch):
    monkeypatch.setattr(pages.store, "__defaults__", (30,))  # many pages
    r = random.Random(9)
    pairs = [(r.randrange(20), r.randrange(20)) for _ in range(90)] + [(25, v) for v in range(20)] + [(21, 22)]
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in range(26)}
    near = {v: ws - {v} for v, ws in near.items()}
    common = {(a, b): len(near[a] & near[b]) for a, b in pairs if a != b}
    before = stored(spark)
    got = {x.eidx: (x.src, x.dst, x.strength) for x in A.edge_strength(from_pairs(spark, 26, pairs), mode).collect()}
    assert len(got) == len(pairs) and len(stored(spark) - before) == 1
    for k, (a, b) in enumerate(pairs):
        t = common.get((a, b), 0)
        below = len(near[a]) + len(near[b]) - 2 - t if mode == "jaccard" else max(common.values()) + max(len(near[a]), len(near[b])) - 1 - t
        assert got[k] == (a, b, pytest.approx(min(1.0, t / below) if a != b and below > 0 else 0.0))
    assert A.edge_strength(from_pairs(spark, 2, [(1, 1)]), mode).collect()[0].strength == 0.0


@pytest.mark.parametrize("stemming", [False, True])
def test_an_index_is_built_without_shuffle(spark, tmp_path, monkeypatch, stemming):
    import re
    from collections import defaultdict

    from graphloom.operators import search

    monkeypatch.setattr(search, "TOKENS", 7)  # documents are cut into many batches
    texts = ["Growing grows, it GROWS", None, "", "plum and pear and plum", "pear", "hopping hop " * 6, "a b a"]
    docs = spark.createDataFrame([(i, t, ["x", None, "x"] if i % 2 else []) for i, t in enumerate(texts)], "idx bigint, text string, tags array<string>")
    index = search.build(docs, {"text": 1.0}, {"tags": 1.0}, stemming=stemming)
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    words = sorted({w for t in texts for w in re.findall(r"\w+", (t or "").lower())})
    stems = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", search.stem(F.col("w")).alias("s")).collect()}
    want = defaultdict(list)
    for i, t in enumerate(texts):
        found = re.findall(r"\w+", (t or "").lower())
        for at, w in enumerate(found):
            want["text", stems[w] if stemming else w, i, len(found)].append(at)
        if i % 2:
            want["tags", "x", i, 3] = [0, 2]
    for made in (index, search.store(index, str(tmp_path / "index"))):
        got = {(r.field, r.term, r.idx, r.len): r.places for r in made.postings.collect()}
        assert got == want
        assert all(r.tf == len(r.places) for r in made.postings.collect())
