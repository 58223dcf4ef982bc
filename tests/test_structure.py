"""Lenses, partitions, links, layouts, history walks and frames against brute force on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.graph import from_pairs
from graphloom.operators import generators, layout, lens, partition, versions
from graphloom.sources import links
from graphloom.streaming import snapshots


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_matching_is_a_maximal_matching(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(90)]
    part = dict(rows(partition.matching(from_pairs(spark, 40, pairs)), "idx", "part"))
    members = {}
    for v, p in part.items():
        members.setdefault(p, []).append(v)
    linked = {frozenset(p) for p in pairs}
    assert all(len(m) == 1 or frozenset(m) in linked for m in members.values())
    single = {m[0] for m in members.values() if len(m) == 1}
    assert not any(a != b and a in single and b in single for a, b in pairs)
    assert sorted(members) == list(range(len(members)))
    assert rows(partition.matching(from_pairs(spark, 2, [(0, 0)])), "idx", "part") == [(0, 0), (1, 1)]


def test_regions_contract_prolong_and_fold(spark):
    g = generators.path(spark, 10)
    parts = partition.regions(g, 3)
    assert rows(parts, "idx", "part") == [(i, min(i // 4, 2)) for i in range(10)]
    assert rows(partition.contract(g, parts), "src", "dst", "weight") == [(0, 1, 1), (1, 2, 1)]
    places = spark.createDataFrame([(float(i), 0.0, 0.0, i) for i in range(10)], "x double, y double, z double, idx bigint")
    means = partition.fold(places, parts)
    assert rows(means, "part", "x") == [(0, 1.5), (1, 5.5), (2, 8.5)]
    assert {r["x"] for r in partition.prolong(means, parts).collect()} == {1.5, 5.5, 8.5}
    moved = partition.prolong(means, parts, jitter=0.25)
    assert all(min(abs(r["x"] - m) for m in (1.5, 5.5, 8.5)) <= 0.25 for r in moved.collect())


def test_hilbert_visits_every_cell_by_steps_of_one(spark):
    got = [(x, y) for _, x, y in rows(layout.hilbert(spark.range(64).withColumnRenamed("id", "idx"), 64, 3, 8.0), "idx", "x", "y")]
    assert len(set(got)) == 64 and got[0] == (-3.5, -3.5)
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(got, got[1:]))
    assert rows(layout.hilbert(spark.range(1).withColumnRenamed("id", "idx"), 1, 1, 2.0), "x", "y") == [(-0.5, -0.5)]


def test_layers_pivots_clusters_ball_angles(spark):
    g = from_pairs(spark, 6, [(0, 1), (0, 2), (1, 3), (2, 3)])  # 4 and 5 are roots of their own
    assert rows(layout.layered(g), "idx", "layer") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 0), (5, 0)]
    assert rows(layout.layered(from_pairs(spark, 3, [(0, 1), (1, 0)])), "idx", "layer") == [(0, 0), (1, 0), (2, 0)]
    assert {r["x"] for r in layout.layered(g, direction="RL").filter("idx = 3").collect()} == {-200.0}
    assert layout.pivots(generators.path(spark, 9), 3) == [0, 8, 4]
    assert layout.pivots(from_pairs(spark, 1, []), 3) == [0]
    one = layout.clusters(spark.createDataFrame([(0, 5), (1, 5)], "idx bigint, cluster bigint"))
    assert [(round(x), round(y)) for _, x, y in rows(one, "idx", "x", "y")] == [(100, 0), (-100, 0)]
    r = [math.dist((0, 0, 0), p) for p in rows(layout.ball(spark.range(4000).withColumnRenamed("id", "idx")), "x", "y", "z")]
    assert max(r) <= 100 and abs(sum(x < 100 * 0.5 ** (1 / 3) for x in r) / 4000 - 0.5) < 0.04
    pos = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, -1.0, 0.0, 0.0)], "idx bigint, x double, y double, z double")
    star = generators.star(spark, 4)
    got = {(a, b): round(math.degrees(t)) for a, b, t in rows(layout.angles(star, pos), "a", "b", "angle")}
    assert got == {(1, 2): 90, (1, 3): 180, (2, 3): 90}
    assert layout.angles(star, pos, most=1).count() == 1


def test_lenses(spark):
    nodes = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "idx bigint, kind string")
    assert rows(lens.dictionary(nodes, "kind"), "idx", "class") == [(0, 0), (2, 1), (3, 0)]
    same = lens.sizes(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v")
    assert {r["size"] for r in same.collect()} == {4.0}
    levels = lens.fill_levels(spark.createDataFrame([(0, i, None if i == 9 else 0) for i in range(10)], "focus int, idx bigint, distance int"), 2)
    assert [v for _, v in rows(levels, "idx", "level")] == [0, 0, 1, 1, 1, 1, 2, 2, 2, 2]


@pytest.mark.parametrize("n", [1, 3, 12])
def test_distortion(spark, n):
    rng = random.Random(n)
    points = [(7, i, round(rng.random() * 10, 3), 1 + rng.random()) for i in range(n)]
    got = dict(rows(lens.distort(spark.createDataFrame(points, "focus int, idx bigint, r double, d double"), 1.5, 4), "idx", "radius"))
    order = sorted(points, key=lambda p: (p[2], p[1]))
    p, f, before, sums = max(min(4, n // 2), 1), 0.0, 0.0, []
    for i, (_, _, r, _) in enumerate(order):
        near = [q[3] for q in order[max(0, i - p) : i + p]]
        f, before = f + ((r - before) / (sum(near) / len(near))) ** 1.5, r
        sums.append(f)
    for (_, idx, _, _), s in zip(order, sums):
        assert got[idx] == pytest.approx(s * order[-1][2] / sums[-1])


def test_links(spark):
    keys = lambda u: spark.range(1).select(links.url_keys(F.lit(u))).first()[0]
    assert keys("https://h/display/S/T?pageId=7&x=1#top") == ["https://h/display/S/T?pageId=7&x=1", "7", "S/T"]
    assert keys("https://h/browse/AB-1") == ["https://h/browse/AB-1", "browse/AB-1", "AB-1"]
    assert keys("") == []
    pages = spark.createDataFrame([(3, "https://h/a/b"), (1, "https://k/a/b"), (2, "x")], "idx bigint, url string")
    asked = spark.createDataFrame([(9, "http://other/a/b"), (9, "https://h/a/b#z"), (9, "http://none/q"), (8, None)], "src bigint, url string")
    found, lost = links.resolve(asked, links.url_index(pages))
    assert rows(found, "src", "dst") == [(9, 1), (9, 3)]
    assert {r["url"] for r in lost.collect()} == {"http://none/q", None}
    records = spark.createDataFrame([("a", ["Beta", "none", "A"]), ("b", ["alpha"])], "id string, refs array<string>")
    targets = spark.createDataFrame([("a", "Alpha"), ("b", "beta"), ("c", "Beta")], "id string, title string")
    edges, missing = links.edge_rule(records, F.col("refs"), targets, "title")
    assert rows(edges, "src", "dst") == [("a", "c"), ("b", "a")] and rows(missing, "value") == [("A",), ("none",)]
    listed = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("a", "a", "x"), ("a", "z", "x"), ("a", "b", "x"), ("a", "c", "y")], "src string, dst string, kind string")
    counts = [links.edge_list(listed, targets, ["x"], how).count() for how in ("none", "ordered", "unordered")]
    assert counts == [3, 2, 1]


def test_titles_snippets_and_ids(spark):
    made = lambda x: spark.range(1).select(text.title(F.lit(x), F.lit("0123456789"), 10, "Note")).first()[0]
    assert [made(x) for x in (None, " \nx", "short", "one two three", "a bcdefghijkl")] == ["Note 01234567", "Note 01234567", "short", "one two…", "a bcdefghi…"]
    cut = spark.range(1).select(text.snippet(F.lit("see <The> cat, the hat; other"), ["the"])).first()[0]
    assert cut == "see &lt;<b>The</b>&gt; cat, <b>the</b> hat; other"
    assert spark.range(1).select(text.snippet(F.lit("other"), ["the"])).first()[0] is None


def test_history_walks(spark):
    parents = spark.createDataFrame([(str(i), str(i - 1), 0) for i in range(1, 40)] + [("9", "3", 1)], "commit string, parent string, nth int")
    assert [p for _, p in sorted(((r["place"], r["commit"]) for r in versions.first_parent_log(parents, "30", 7).collect()))] == [str(i) for i in range(30, 23, -1)]
    assert versions.first_parent_log(parents, "2", 100).count() == 3
    commits = spark.createDataFrame([(str(i),) for i in range(5)], "commit string")
    few = parents.filter("int(commit) < 5 and nth = 0")
    assert rows(versions.topological(commits, few), "level", "commit") == [(i, str(i)) for i in range(5)]
    with pytest.raises(ValueError, match="cycle"):
        versions.topological(commits, few.unionByName(spark.createDataFrame([("0", "4", 0)], few.schema)))


def test_keyframes_are_restored(spark):
    rng = random.Random(5)
    frames = [(i % 3, i, float(rng.randrange(100)), 0.0, 1.0) for i in range(50)]
    df = spark.createDataFrame(frames, "idx bigint, frame bigint, x double, y double, z double")
    assert rows(snapshots.restored(snapshots.keyframed(df, 4)), "idx", "frame", "x", "y", "z") == sorted(frames)
    moved = rows(snapshots.displacement(df.filter("idx = 0")), "frame", "most")
    xs = [f[2] for f in frames if f[0] == 0]
    assert [m for _, m in moved] == [0.0, *(abs(a - b) for a, b in zip(xs[1:], xs))]
