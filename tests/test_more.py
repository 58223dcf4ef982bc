"""Partitions, forces, the version store, listings and importers against plain versions on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import from_pairs
from graphloom.operators import analytics as A
from graphloom.operators import forces, generators, layout, listings, measures, partition, versions
from graphloom.operators.store import Store
from graphloom.sources import importers


def col(df, name):
    return {r["idx"]: r[name] for r in df.collect()}


def test_regions_leave_their_frontier_behind(spark):
    assert col(partition.regions(from_pairs(spark, 6, [(0, 4), (4, 5)]), 3), "part") == {0: 0, 4: 0, 1: 1, 2: 1, 3: 2, 5: 2}
    rnd = random.Random(5)
    pairs = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(40)]
    near = {v: sorted({b for a, b in pairs if a == v} | {a for a, b in pairs if b == v}) for v in range(30)}
    want, left = {}, 30
    for k in range(4):
        room, line = (30 if k == 3 else 8), []
        while room and len(want) < 30:
            if not line:
                line = [min(v for v in range(30) if v not in want)]
                want[line[0]], room = k, room - 1
                continue
            for w in near[line.pop(0)]:
                if w not in want and room:
                    want[w], room = k, room - 1
                    line.append(w)
    assert left == len(want) and col(partition.regions(from_pairs(spark, 30, pairs), 4), "part") == want


def test_refinement_cuts_fewer_edges_and_stays_balanced(spark):
    cliques = [(a + s, b + s) for s in (0, 10) for a in range(10) for b in range(a)] + [(0, 10)]
    g = from_pairs(spark, 20, cliques)
    mixed = spark.createDataFrame([(i, 1 if i in (3, 12, 13, 14, 15, 16, 17, 18, 19, 10) else 0) for i in range(20)], "idx bigint, part bigint")
    out = partition.refined(g, mixed, 2)
    assert A.boundary(g, out)[2].first()[0] < A.boundary(g, mixed)[2].first()[0]
    sizes = [r["n"] for r in out.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert all(9 <= n <= 11 for n in sizes)


def test_matchings_and_cascade(spark):
    g = from_pairs(spark, 7, [(1, 1), (1, 2), (2, 3), (3, 4), (5, 1)])
    assert col(partition.first_touch(g), "part") == {1: 0, 2: 0, 3: 1, 4: 1, 0: 2, 5: 3, 6: 4}
    ring = generators.cycle(spark, 200)
    levels = partition.cascade(ring, 8, 20)
    sizes = [h.nodes.count() for h, _ in levels]
    assert sizes[0] == 200 and all(a > b for a, b in zip(sizes, sizes[1:])) and levels[-1][1] is None
    for (h, parts), (up, _) in zip(levels, levels[1:]):
        assert parts.count() == h.nodes.count() and parts.select("part").distinct().count() == up.nodes.count()
        assert parts.groupBy("part").count().agg(F.max("count")).first()[0] <= 2
    first = partition.cascade(ring, 2, 20, partition.first_touch)
    assert first[1][0].nodes.count() == 100


def _points(spark, n, seed=3):
    rnd = random.Random(seed)
    return [(i, *(rnd.uniform(-50, 50) for _ in range(3)), float(rnd.randint(1, 5))) for i in range(n)]


@pytest.mark.parametrize(("theta", "close"), [(0.0, 1e-9), (0.7, 0.05)])
def test_far_field(spark, theta, close):
    rows = _points(spark, 60) + [(60, 1.0, 1.0, 1.0, 2.0), (61, 1.0, 1.0, 1.0, 3.0)]  # two at one place
    got = {r.idx: (r.fx, r.fy, r.fz) for r in forces.far_field(spark.createDataFrame(rows, "idx bigint, x double, y double, z double, mass double"), theta).collect()}
    amiss = whole = 0.0
    for i, *p, _ in rows:
        want = [0.0, 0.0, 0.0]
        for j, *q, m in rows:
            if i != j:
                d = [a - b for a, b in zip(p, q)]
                want = [w + m * x / max(sum(y * y for y in d), 1e-4) for w, x in zip(want, d)]
        amiss += math.dist(got[i], want)
        whole += math.hypot(*want)
    assert amiss <= close * whole and len(got) == len(rows)
    assert forces.far_field(spark.createDataFrame([], "idx bigint, x double, y double, z double, mass double")).collect() == []


@pytest.mark.parametrize("name", sorted(forces.ENGINES))
def test_engines_move_and_stay_finite(spark, name):
    g = generators.path(spark, 6)
    pos = forces.engine(name, target=3, rounds=6, pivots=2, sweeps=1).init(g).run(1).collect()
    assert len(pos) == 6 and all(math.isfinite(v) for r in pos for v in (r.x, r.y, r.z)) and len({(round(r.x, 6), round(r.y, 6)) for r in pos}) == 6


def test_engines_by_name(spark):
    with pytest.raises(ValueError):
        forces.engine("none")
    assert forces.engine("fa2-bh").init(from_pairs(spark, 0, [])).step().collect() == []


def test_stress_engine_lowers_stress(spark):
    g = generators.path(spark, 8)
    e = forces.engine("sgd-stress", rounds=8, pivots=3).init(g)
    before = measures.all_pairs_stress(g, e.pos).first()["stress"]
    assert measures.all_pairs_stress(g, e.run(8)).first()["stress"] < 0.9 * before


def test_all_pairs_stress_of_a_line_is_none(spark):
    g = generators.path(spark, 6)
    line = g.nodes.select("idx", (F.col("idx") * 3.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    row = measures.all_pairs_stress(g, line).first()
    assert row["pairs"] == 15 and row["stress"] == pytest.approx(0)


def test_measures(spark):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    xyz = "x double, y double, z double"
    assert measures.nematic_order(frame([(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0)], xyz)).first()[0] == pytest.approx(1)
    assert measures.nematic_order(frame([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)], xyz)).first()[0] == pytest.approx(0)
    assert measures.nematic_order(frame([(0.6, 0.8, 0.0)] * 3, xyz)).first()[0] == pytest.approx(1)
    assert measures.nematic_order(frame([], xyz)).first()[0] == 0
    shell = layout.sphere(spark.range(600).withColumnRenamed("id", "idx"), 600)
    whole, half = measures.closure(shell).first(), measures.closure(shell.filter("y > 0")).first()
    assert whole["closed"] and whole["closure"] > 0.95 and whole["gyration"] == pytest.approx(100, rel=0.01) and not half["closed"]
    rows = [(0, 0, 1.0, 0.0, 0.0), (0, 1, 4.0, 0.0, 0.0), (1, 0, 4.0, 4.0, 0.0), (1, 1, float("nan"), 0.0, 0.0)]
    out = {r.frame: r for r in measures.telemetry(frame(rows, "frame int, idx bigint, " + xyz)).collect()}
    assert out[1].most == 4 and out[1].not_finite == 1 and out[1].mean_move == 2.5 and out[1].p50_radius == pytest.approx(32**0.5) and out[0].p99_radius == 1


def _store(spark, path):
    s, node = Store(spark, str(path)), "seq int, kind string, id string, body string"
    up = lambda *rows: spark.createDataFrame([(i, "upsert_node", a, b) for i, (a, b) in enumerate(rows)], node)
    gone = lambda a: spark.createDataFrame([(0, "delete_node", a, None)], node)
    link = lambda a, b: spark.createDataFrame([(0, "upsert_edge", a, b)], "seq int, kind string, src string, dst string")
    return s, up, gone, link


def test_store_branches_merges_and_rebases(spark, tmp_path):
    s, up, gone, link = _store(spark, tmp_path / "a")
    first = s.commit("main", up(("a", '{"k":1,"t":"x"}'), ("b", '{"k":1}')), link("a", "b"), "first", 1)
    s.create_branch("dev", first)
    with pytest.raises(ValueError):
        s.create_branch("dev", first)
    with pytest.raises(LookupError):
        s.merge("main", "nowhere")
    dev = s.commit("dev", up(("a", '{"k":2,"t":"x"}'), ("c", "{}")), link("c", "a"), "dev", 2)
    assert s.merge("dev", "main") == ("up-to-date", dev)
    assert s.merge("main", "dev") == ("fast-forward", dev) and s.head("main") == dev
    s.commit("main", up(("b", '{"k":7}')), None, "main", 3)
    s.commit("dev", up(("b", '{"k":8}'), ("d", "{}")), None, "dev again", 4)
    kind, head = s.merge("main", "dev", ts=5)
    nodes, edges = s.snapshot(head)
    assert kind == "three-way" and {r.id: r.body for r in nodes.collect()} == {"a": '{"k":2,"t":"x"}', "b": '{"k":7}', "c": "{}", "d": "{}"}
    assert sorted(map(tuple, edges.collect())) == [("a", "b"), ("c", "a")] and [r.id for r in s.conflicts(head).collect()] == ["b"]
    later = s.commit("main", gone("d"), None, "more", 6)
    assert s.conflicts(later).count() == 1  # open ones stay open
    done = s.resolve("main", spark.createDataFrame([("b", "theirs", None)], "id string, choice string, body string"), ts=7)
    assert s.conflicts(done).count() == 0 and {r.id: r.body for r in s.snapshot(done)[0].collect()}["b"] == '{"k":8}'
    assert [r.message for r in s.log("main").collect()] == ["resolve", "more", "merge", "main", "dev", "first"] and s.log("none").collect() == []
    assert s.attributes("main").first()["message"] == "resolve" and {r.name for r in s.branches().collect()} == {"main", "dev"}
    copy = Store(spark, str(tmp_path / "b"))
    out = s.export()
    copy.restore(out)
    assert copy.head("main") == done and sorted(map(tuple, copy.snapshot(done)[0].collect())) == sorted(map(tuple, s.snapshot(done)[0].collect()))
    with pytest.raises(ValueError):
        copy.restore(out)
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "c")).restore(out | {"commits": out["commits"].filter("place > 0")})


def test_store_rebase_keeps_changes(spark, tmp_path):
    s, up, _, _ = _store(spark, tmp_path / "a")
    first = s.commit("main", up(("a", '{"k":1,"t":"x"}')), None, "first", 1)
    s.create_branch("dev", first)
    s.commit("dev", up(("b", "{}")), None, "one", 2)
    s.commit("dev", up(("a", '{"k":2,"t":"x"}')), None, "two", 3)
    s.commit("main", up(("a", '{"k":1,"t":"y"}')), None, "other", 4)
    old = {r.message: (r.commit, r.change) for r in s.log("dev").collect()}
    s.rebase("dev", "main")
    log = s.log("dev").collect()
    assert [r.message for r in log] == ["two", "one", "other", "first"]
    assert all(r.change == old[r.message][1] and r.commit != old[r.message][0] for r in log[:2])
    assert {r.id: r.body for r in s.snapshot(s.head("dev"))[0].collect()} == {"a": '{"k":2,"t":"y"}', "b": "{}"}


def test_world_source(spark, tmp_path):
    s, up, _, link = _store(spark, tmp_path / "a")
    assert [x.count() for x in s.world("My World")] == [0, 0, 0, 0]
    s.commit("main", up(("n/1", '{"title":"One","type":"page"}'), ("n/2", '{"title":" "}')), link("n/1", "n/2"))
    s.commit("main", None, link("n/2", "gone"))
    nodes, edges, docs, loose = s.world("My World")
    assert sorted(map(tuple, nodes.collect())) == [("world:my-world:n/1", "One", "page"), ("world:my-world:n/2", "n/2", "note")]
    assert [tuple(r) for r in edges.collect()] == [("world:my-world:n/1", "world:my-world:n/2")] and loose.count() == 1 and "body" in docs.columns


def _subsequence(text, query):
    score, last, at = 0, None, 0
    for c in query.lower():
        at = text.lower().find(c, at)
        if at < 0:
            return None
        score += (5 if last is not None and at == last + 1 else 1) + (2 if at < 8 else 0)
        last, at = at, at + 1
    return score


def test_listings(spark):
    names = ["Open file", "open folder", "Fold up", "profile", "", "ooo"]
    for q in ("o", "of", "fold", "pf", "zz"):
        got = [r.s for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(listings.subsequence_score(F.col("n"), q).alias("s")).collect()]
        want = [_subsequence(n, q) for n in names]
        assert [x if x is None or x != 0 else x for x in got] == [w if w is None else w + (5 - 1 if False else 0) for w in want], q
    acts = spark.createDataFrame([("a.1", "Open file", "from disk", ["load"]), ("a.2", "Close", "opens nothing", []), ("a.3", "Zoom", None, [])], "id string, title string, description string, keywords array<string>")
    assert [r.id for r in listings.ranked_actions(acts, "open").collect()] == ["a.1", "a.2"]
    tags = spark.createDataFrame([(i, t) for i, ts in enumerate([["b", "a"], ["a", "b"], ["c"], ["ab"]]) for t in ts], "idx bigint, tag string")
    assert [r.tag for r in listings.top_tags(tags).collect()] == ["a", "b", "ab", "c"] and [r.tag for r in listings.top_tags(tags, "b").collect()] == ["b", "ab"] and listings.top_tags(tags, k=1).count() == 1
    star = generators.star(spark, 6)
    pills = listings.neighbour_pills(star, 0, 3).collect()
    assert len(pills) == 3 and {r.left_out for r in pills} == {2}
    assert [r.n for r in listings.label_order(spark.createDataFrame([("b",), ("B",), ("a",)], "n string"), "n").collect()] == ["a", "B", "b"]
    paths = spark.createDataFrame([("x/a.md",), ("x/.git/a.md",), (".a.md",), ("a.txt",), ("A.MD",)], "p string")
    assert [r.k for r in paths.select(listings.relevant_path(F.col("p")).alias("k")).collect()] == [True, False, False, False, True]


def test_apply_edges_is_a_set(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    ops = spark.createDataFrame([(1, "delete_edge", "a", "b"), (2, "upsert_edge", "a", "b"), (3, "delete_edge", "b", "c"), (4, "upsert_edge", "x", "y")], "seq int, kind string, src string, dst string")
    assert sorted(map(tuple, versions.apply_edges(edges, ops).collect())) == [("a", "b"), ("x", "y")]


def test_dotted_paths():
    value = {"sources": [{"title": "a", "n": 1}, {"title": ["b", ["c"]]}, "d"], "one": {"two": "e"}, "flag": True}
    of = lambda p, v=value: importers.DottedPath(p).of(v)
    assert of("sources[*].title") == ["a", "b", "c", "d"] and of("one.two") == ["e"] and of("flag") == [] and of("sources[*].n") == ["d"]
    assert of("sources") == ["d"] and of("none.two") == [] and of("[*]", ["x", ["y"], 3]) == ["x", "y"] and of("any", "bare") == ["bare"]


def test_importers(spark):
    notes = spark.createDataFrame([("a/x.md", "---\nstatus: live\nentities: [A, B, A]\nauthors: p, q\n---\nbody"), ("y.md", "---\nnot a field\n---\nrest"), ("z.md", None)], "path string, text string")
    found = {r.path: r for r in importers.discovery(importers.split_frontmatter(notes)).collect()}
    assert found["a/x.md"].entities == ["A", "B"] and found["a/x.md"].authors == ["p", "q"] and found["a/x.md"].folder == "a" and found["y.md"].status is None and found["z.md"].entities is None
    with pytest.raises(Exception, match="malformed"):
        importers.split_frontmatter(notes, strict=True).collect()
    rows = spark.createDataFrame([('{"a":1}',), ("{oops",)], "j string")
    assert [r.value and r.value.a for r in importers.decoded_json(rows, "j", "a int").collect()] == [1, None]
    with pytest.raises(Exception):
        importers.decoded_json(rows, "j", "a int", strict=True).collect()
    about = importers.Descriptor("notes", "memory", ("read", "content"), "vault/a")
    chain = importers.Chain(about, lambda: notes, lambda df: importers.Loaded(df, df.limit(0), df, df.limit(0)), (importers.split_frontmatter,))
    with pytest.raises(PermissionError):
        importers.run(chain, importers.Policy(frozenset({("read", "memory", "")})))
    grants = frozenset({("read", "memory", "vault/"), ("content", "memory", "vault/a")})
    assert importers.run(chain, importers.Policy(grants)).nodes.columns == ["path", "props", "body"]
    with pytest.raises(ValueError):
        importers.Policy(grants).check(importers.Descriptor("x", "pigeon"))
    text = spark.createDataFrame([('{"a":{"b":"x"},"n":5}',), ("none",)], "j string").select(importers.json_text("j", "/a/b").alias("b"), importers.json_text("j", "/n").alias("n")).collect()
    assert [tuple(r) for r in text] == [("x", "5"), (None, None)]


def test_compute_all(spark):
    g = generators.cycle(spark, 6)
    rows = A.compute_all(g).collect()
    assert len(rows) == 6 and {r.core for r in rows} == {2} and {r.wcc for r in rows} == {0} and all(r.pagerank == pytest.approx(1 / 6) for r in rows)


def test_sql_free_queries_agree_with_plain_versions(spark):
    """Core numbers by peeling, of the graph of users."""
    from graphloom.plans import queries

    d = "/root/testdata/sf0.001"
    g = queries.users(spark, d)
    near = {r.idx: set() for r in g.nodes.select("idx").collect()}
    for r in g.neighbours().collect():
        near[r.src].add(r.dst)
    core, left, k = {}, {v: set(w) for v, w in near.items()}, 0
    while left:
        low = [v for v in left if len(left[v]) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            core[v] = k
            for w in left.pop(v):
                if w in left:
                    left[w].discard(v)
    assert col(queries.metric_core_numbers(spark, d), "core") == core
