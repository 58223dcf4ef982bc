"""Metrics, filters, versions and sources against hand cases and plain Python."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import numeric, text
from graphloom.graph import Graph, build, dense_index, from_pairs, integrity
from graphloom.operators import analytics as A
from graphloom.operators import filters, generators, layout, search, versions

TRIANGLE = [(0, 1), (1, 2), (2, 0)]


def col(df, name):
    return {r["idx"]: r[name] for r in df.collect()}


def test_degrees_count_loops_and_parallel_edges(spark):
    g = from_pairs(spark, 4, [(0, 0), (0, 1), (0, 1)])
    assert {r.idx: (r.degree, r.indegree, r.outdegree) for r in A.degrees(g).collect()} == {0: (4, 1, 3), 1: (2, 2, 0), 2: (0, 0, 0), 3: (0, 0, 0)}


def test_pagerank_mass_and_symmetry(spark):
    r = col(A.pagerank(from_pairs(spark, 3, TRIANGLE), iterations=7), "pagerank")
    assert sum(r.values()) == pytest.approx(1) and max(r.values()) == pytest.approx(min(r.values()))
    dangling = col(A.pagerank(from_pairs(spark, 3, [(0, 1), (0, 2)]), iterations=20), "pagerank")
    assert sum(dangling.values()) == pytest.approx(1) and dangling[1] > dangling[0]


def test_components_and_first_seen_labels(spark):
    g = from_pairs(spark, 6, [(4, 2), (2, 1), (5, 3)])
    assert col(A.components(g), "component") == {0: 0, 1: 1, 2: 1, 4: 1, 3: 3, 5: 3}
    assert col(A.wcc(g), "wcc") == {0: 0, 1: 1, 2: 1, 4: 1, 3: 2, 5: 2}
    assert col(A.components(from_pairs(spark, 3, [])), "component") == {0: 0, 1: 1, 2: 2}


def test_bfs(spark):
    assert col(A.bfs(generators.path(spark, 6), 2), "distance") == {i: abs(i - 2) for i in range(6)}
    grid = col(A.bfs(generators.grid(spark, 3, 4), 0), "distance")
    assert grid == {r * 4 + c: r + c for r in range(3) for c in range(4)}
    assert col(A.bfs(from_pairs(spark, 3, [(0, 1)]), 0), "distance")[2] is None


def test_betweenness_of_a_path(spark):
    b = col(A.betweenness(generators.path(spark, 5)), "betweenness")
    assert [round(b[i] * 12) for i in range(5)] == [0, 6, 8, 6, 0]


def test_core_numbers(spark):
    pendant = from_pairs(spark, 4, [*TRIANGLE, (2, 3)])
    assert col(A.core_numbers(pendant), "core") == {0: 2, 1: 2, 2: 2, 3: 1}
    assert col(A.kcore_sweep(from_pairs(spark, 3, TRIANGLE)), "kcore") == {0: 2, 1: 2, 2: 2}
    assert col(A.kcore_sweep(generators.star(spark, 5)), "kcore") == dict.fromkeys(range(5), 0)
    assert col(A.kcore_sweep(from_pairs(spark, 4, [(0, 2), (0, 3), (1, 3)])), "kcore") in ({0: 0, 1: 1, 2: 0, 3: 1}, {0: 1, 1: 0, 2: 1, 3: 0})


def test_louvain_separates_triangles(spark):
    g = from_pairs(spark, 6, [*TRIANGLE, (3, 4), (4, 5), (5, 3), (2, 3)])
    c = A.louvain(g)
    labels = col(c, "community")
    assert len(set(labels.values())) == 2 and labels[0] == labels[1] == labels[2] and labels[3] == labels[4] == labels[5]
    assert A.modularity(g, c).first()[0] == pytest.approx(6 / 7 - 0.5)
    assert col(A.louvain(from_pairs(spark, 3, [])), "community") == {0: 0, 1: 1, 2: 2}


def test_edge_strength(spark):
    g = from_pairs(spark, 6, [*TRIANGLE, (3, 4), (4, 5), (5, 3), (2, 3), (1, 1)])
    s = {(r.src, r.dst): r.strength for r in A.edge_strength(g).collect()}
    assert s[(0, 1)] == 1 and s[(2, 3)] == 0 and s[(1, 1)] == 0 and len(s) == 8
    assert {r.strength for r in A.edge_strength(g, "corrected").filter("src = 0 and dst = 1").collect()} == {1 / (1 + 2 - 1 - 1)}


def test_label_propagation_and_spmv(spark):
    assert col(A.label_propagation(from_pairs(spark, 5, [*TRIANGLE, (3, 4)]), 1), "label") == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    m = spark.createDataFrame([(0, 0, 2.0), (0, 1, 0.1), (1, 1, 3.0)], "row bigint, col bigint, w double")
    x = spark.createDataFrame([(0, 1.0), (1, 10.0)], "col bigint, x double")
    assert {r.row: r.y for r in A.spmv(m, x).collect()} == {0: 3.0, 1: 30.0}
    assert {r.row: round(r.y, 4) for r in A.spmv(m, x, half=True).collect()}[0] == pytest.approx(2.9998, abs=1e-4)


def test_partition_boundary(spark):
    owners = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "idx bigint, part int")
    ghosts, border, cut = A.boundary(generators.path(spark, 4), owners)
    assert {tuple(r) for r in ghosts.collect()} == {(0, 2), (1, 1)} and {tuple(r) for r in border.collect()} == {(0, 1), (1, 2)} and cut.first()[0] == 1


def test_dense_index_and_integrity(spark):
    nodes = spark.createDataFrame([(f"k:s:{i:03d}",) for i in range(57)], "id string").repartition(5)
    assert {r.id: r.idx for r in dense_index(nodes, "id").collect()} == {f"k:s:{i:03d}": i for i in range(57)}
    edges = spark.createDataFrame([("k:s:001", "k:s:002"), ("k:s:001", "none"), ("none", "k:s:001")], "src string, dst string")
    assert build(nodes, edges).edges.count() == 1
    bad = nodes.unionAll(spark.createDataFrame([("k:s:001",), ("bad",)], "id string"))
    assert {r.rule: r.n for r in integrity(bad, edges).collect()} == {"repeated id": 1, "missing end": 2, "malformed id": 1}


@pytest.fixture(scope="module")
def facets(spark):
    return spark.createDataFrame([(0, ["oak"], "open"), (1, ["oak", "elm"], "shut"), (2, ["elm"], "open"), (3, ["oak"], "shut"), (4, ["ash", "elm"], "open")], "idx bigint, tags array<string>, status string")


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        (filters.Group("all", (filters.Group("any", (filters.Rule("tags", "eq", "oak"), filters.Rule("tags", "eq", "ash"))), filters.Rule("status", "eq", "shut", negated=True))), {0, 4}),
        (filters.Group("all", (filters.Rule("tags", "eq", "fir"),)), set()),
        (filters.Group(), {0, 1, 2, 3, 4}),
        (filters.Group("all", (filters.Rule("tags", "neq", "oak"),)), {2, 4}),
        (filters.Group("all", (filters.Rule("nope", "neq", "x"),)), set()),
        (filters.Group("any", (filters.Rule("tags", "contains", "AS"), filters.Rule("status", "matches", "^sh"))), {1, 3, 4}),
        (filters.Group("all", (filters.Rule("status", "matches", "("),)), set()),
        (filters.Group("all", (filters.Rule("status", "matches", "(?P<x>o)"),)), set()),  # Python's, not the JVM's
        (filters.Group("all", (filters.Rule("status", "matches", "\\p{javaLowerCase}pen"),)), {0, 2, 4}),  # the JVM's, not Python's
        (filters.Group("any", (filters.Rule("", "search", "a"), filters.Rule("", "search", "b"))), {0, 1, 2}),
    ],
)
def test_filter_trees(facets, tree, want):
    f = filters.Filter(tree, ("tags", "status"), {"a": F.col("idx").isin(0, 1), "b": F.col("idx").isin(1, 2)})
    assert {r.idx for r in f.apply(facets).collect()} == want


def test_filter_counts_problems_and_edits(facets):
    tree = filters.from_chips({"tag": ["oak", "elm"], "status": ["open"]})
    f = filters.Filter(tree, ("tags", "status"))
    assert f.counts(facets).first().asDict() == {"root": 3, "root_0": 5, "root_0_0": 3, "root_0_1": 3, "root_1": 3, "root_1_0": 3}
    assert filters.active_equalities(tree) == {("tags", "oak"), ("tags", "elm"), ("status", "open")}
    smaller = filters.edit(tree, (1, 0), lambda _: None)
    assert len(smaller.children) == 1
    assert filters.Filter(filters.Group("all", (filters.Group(), filters.Rule("x", "eq", "1"), filters.Rule("tags", "eq", " "), filters.Rule("tags", "matches", "["))), ("tags",)).problems() == [("root_0", "empty group"), ("root_1", "unknown field"), ("root_2", "blank value"), ("root_3", "bad pattern")]


def test_filter_trees_are_added_to_moved_and_switched(spark):
    a, b, c = (filters.Rule("tags", "eq", x) for x in "abc")
    tree = filters.Group("all", (filters.Group("any", (a, b)), c))
    assert filters.insert(tree, (0,), 1, c).children[0].children == (a, c, b)
    assert filters.move(tree, (1,), (0,), 0) == filters.Group("all", (filters.Group("any", (c, a, b)),))
    assert filters.move(tree, (0, 0), (), 2) == filters.Group("all", (filters.Group("any", (b,)), c, a))
    lone = filters.Group("all", (filters.Group("any", (a,)), c))
    assert filters.move(lone, (0, 0), (), 0) == filters.Group("all", (a, c))  # the emptied group goes
    with pytest.raises(ValueError):
        filters.move(tree, (0,), (0,), 0)
    assert not filters.toggled(tree, (1,)).children[1].enabled and filters.toggled(filters.toggled(tree, (1,)), (1,)) == tree
    assert filters.cleared(tree).children == ()


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [(0, "Growing pears and plums", ["fruit", "tree"], "Manual"), (1, "Plum trees grow slowly; pear trees do not", ["tree"], "Note"), (2, "Boats of the river", ["water"], "Note"), (3, None, [], None)]
    return spark.createDataFrame(rows, "idx bigint, title string, tags array<string>, kind string")


def test_search(shelf, tmp_path):
    index = search.build(shelf, {"title": 2.0}, {"tags": 1.0, "kind": 1.0})
    for index in (index, search.store(index, str(tmp_path / "index"))):
        ask = lambda q, i=index: sorted(r.idx for r in search.rank(i, q, {"title"}).collect())
        assert ask("tags:tree") == [0, 1] and ask("kind:Note") == [1, 2] and ask("tags:tre") == [] and ask("river boats") == [2] and ask("river plums") == [] and ask("") == []
        assert ask('"of the river"') == [2] and ask('"river the"') == [] and ask('title:"pear trees"') == [1]
        assert ask("pears OR river") == [0, 2] and ask("kind:Note -river") == [1] and ask("kind:Note NOT title:trees") == [2] and ask("tags:tree OR tags:water AND kind:Note") == [1, 2]
        assert ask("NOT river") == [] and ask("pears tree") == [0]  # a word may match in any field
        with pytest.raises(ValueError):
            ask("nofield:value")
    top = search.rank_with_total(index, "kind:Note", {"title"}, 1).collect()
    assert len(top) == 1 and top[0].total == 2


def test_stemming(spark, shelf):
    pairs = "walk walks walked walking,stone stones,plum plums,grow growing grows,hop hopping hopped,hope hoping hoped,pony ponies,kindness kind,relational relate,sized sizing size,the the,is is".split(",")
    for p in pairs:
        forms = spark.createDataFrame([(w,) for w in p.split()], "w string").select(search.stem(F.col("w")).alias("s")).collect()
        assert len({r.s for r in forms}) == 1, p
    index = search.build(shelf, {"title": 1.0}, stemming=True)
    assert sorted(r.idx for r in search.score(index, "grow pear", {"title"}).collect()) == [0, 1]
    assert [r.idx for r in search.score(index, '"pear and plum"', {"title"}).collect()] == [0]


def test_layouts(spark):
    g = generators.grid(spark, 4, 4)
    pos = layout.grid(g.nodes, 16)
    assert layout.length_variation(g, pos).first()[0] == pytest.approx(0)
    assert layout.crossings(g, pos, 15.0).first()[0] == 0
    crossed = from_pairs(spark, 4, [(0, 3), (1, 2)])
    square = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 0.0)], "idx bigint, x double, y double, z double")
    assert layout.crossings(crossed, square, 0.4).first()[0] == 1
    radius = layout.sphere(spark.range(10).withColumnRenamed("id", "idx"), 10).select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r")).collect()
    assert all(r.r == pytest.approx(100) for r in radius)
    points = square.withColumn("r", F.lit(0.5))
    assert {(r.idx, r.idx2) for r in layout.contacts(points, 1.0, 1.0).collect()} == {(0, 1), (0, 2), (1, 3), (2, 3)}


def test_versions(spark):
    nodes = lambda rows: spark.createDataFrame(rows, "id string, body string")
    base, ours, theirs = nodes([("a", '{"x":1}'), ("b", '{"k":1}'), ("c", "{}"), ("d", "{}")]), nodes([("a", '{"x":1,"y":2}'), ("b", '{"k":2}'), ("d", "{}")]), nodes([("a", '{"x":1,"z":3}'), ("b", '{"k":3}'), ("c", '{"e":1}'), ("d", "{}"), ("n", "{}")])
    got = {r.id: (r.body, r.clean) for r in versions.merge_nodes(base, ours, theirs).collect()}
    assert got == {"a": ('{"x":1,"y":2,"z":3}', True), "b": ('{"k":2}', False), "c": (None, False), "d": ("{}", True), "n": ("{}", True)}
    ops = versions.diff_nodes(base, ours).withColumn("seq", F.lit(1))
    assert {tuple(r) for r in versions.apply_nodes(base, ops).collect()} == {tuple(r) for r in ours.collect()}
    parents = spark.createDataFrame([("m", "a2"), ("a2", "a1"), ("a1", "r"), ("b1", "a1")], "commit string, parent string")
    assert versions.common_ancestor(parents, "m", "b1").first()["commit"] == "a1"
    assert [r["commit"] for r in versions.replayed(parents, "m", "b1").collect()] == ["a2", "m"]


def test_notes(spark):
    from graphloom.sources.notes import extract

    notes = spark.createDataFrame([("one.md", "---\ntitle: First\ntags: [a, b]\ndoctype: runbook\n---\nSee [[two]] and [[Second|x]] and [[gone#h]]. #inline `#`\n```\n#no\n```"), ("two.md", "---\ntitle: Second\ntags: alpha, beta\n---\n[[First]]"), ("three.md", "no links")], "path string, text string")
    nodes, edges, missing = extract(notes)
    rows = {r.id: r for r in nodes.collect()}
    assert rows["one"].tags == ["a", "b", "inline"] and rows["one"].doctype == "runbook" and rows["two"].tags == ["alpha", "beta"] and rows["three"].title == "three"
    assert sorted(map(tuple, edges.collect())) == [("one", "two"), ("one", "two"), ("two", "one")] and [tuple(r) for r in missing.collect()] == [("one", "gone")]


def test_text_functions(spark):
    assert text.wikilinks("To [[North Pier]], [[Mill|the mill]], then [[Quay#Steps]]; [[ ]] [[open") == ["North Pier", "Mill", "Quay", "open"]
    assert text.fuzzy_score("ab", "xxab") == 7 and text.fuzzy_score("ba", "ab") is None
    row = spark.createDataFrame([('{"a":{"b/c":[" x "]}}', "Hello, World!", "a/b/c", "OPS-12")], "j string, t string, g string, k string")
    got = row.select(text.pointer(F.col("j"), "/a/b~1c/0").alias("p"), text.slug(F.col("t")).alias("s"), text.tag_branches(F.col("g")).alias("b"), text.kind_of(F.col("k")).alias("k"), text.fuzzy("hw")(F.col("t")).alias("f")).first()
    assert (got.p, got.s, got.b, got.k) == ("x", "hello-world", ["a", "a/b", "a/b/c"], "ticket") and got.f == 8
    assert numeric.nearest_rank(spark.createDataFrame([(float(i),) for i in [5, 1, 4, 2, 3]], "v double"), "v", 0.5).first()[0] == 3


def test_graph_files(spark, tmp_path):
    from graphloom.sources import files

    (tmp_path / "e.csv").write_text("id,source,target,weight\n1,a,b,2\n")
    kind, rows = files.read_csv(spark, str(tmp_path / "e.csv"))
    assert kind == "edges" and rows.first().weight == "2"
    (tmp_path / "g.dot").write_text('digraph G {\n a [label="x"];\n a -> b;\n}\n')
    nodes, edges = files.read_dot(spark, str(tmp_path / "g.dot"))
    assert [r.id for r in nodes.collect()] == ["a"] and [(r.src, r.dst) for r in edges.collect()] == [("a", "b")]
    (tmp_path / "c.bin").write_bytes(files.csr_bytes(3, [(0, 1), (1, 0), (1, 2), (2, 1)]))
    assert sorted(map(tuple, files.read_csr(spark, str(tmp_path / "c.bin")).collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    owner = '{"apiVersion":"v1","kind":"Deployment","metadata":{"name":"d","uid":"o","labels":{"app":"x"}}}'
    child = '{"apiVersion":"v1","kind":"ReplicaSet","metadata":{"name":"r","uid":"c","ownerReferences":[{"uid":"o"},{"uid":"gone"}]}}'
    nodes, edges, missing = files.kubernetes(spark.createDataFrame([(owner,), (child,)], "body string"))
    assert {r.id: r.tags for r in nodes.collect()}["uid:o"] == ["Deployment", "kubernetes", "label:app=x"]
    assert [tuple(r) for r in edges.collect()] == [("uid:o", "uid:c")] and missing.count() == 1
    pages = spark.createDataFrame([(0, '{"items":[{"id":"a","t":"one"},{"id":"b","t":"two"}]}'), (1, '{"items":[{"id":"a","t":"again"}]}')], "page int, body string")
    assert {r.id: r.title for r in files.map_items(pages, "items", {"id": "id", "title": "t"}).collect()} == {"a": "one", "b": "two"}


def test_snapshots(spark, tmp_path):
    from graphloom.streaming import snapshots as S

    store, folder = S.Snapshots(spark, str(tmp_path / "store")), str(tmp_path / "in")
    spark.range(5).write.parquet(folder)
    q = S.refresh(spark.readStream.schema("id bigint").parquet(folder), lambda df: df.filter("id > 1"), store, str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert store.read().count() == 3 and store.revision() == 1
    with pytest.raises(LookupError):
        store.read(expected=7)
    events = spark.range(3000).withColumnRenamed("id", "seq")
    assert S.since(events, 2990).count() == 10 and S.since(events, 0).count() == 1024


def test_generators(spark):
    assert generators.complete(spark, 4).edges.count() == 12 and generators.cycle(spark, 5).edges.count() == 5
    g = generators.path(spark, 4)
    assert generators.remove_node(g, 1).edges.count() == 1 and generators.is_subgraph(generators.remove_node(g, 3), g)
    assert generators.subdivide(g).count() == 6 and isinstance(generators.clustered(spark, 20, 50, 4, 0.9), Graph)


def test_refresh_does_not_lose_what_failed(spark, tmp_path):
    from graphloom.streaming import snapshots as S

    store, folder, broken = S.Snapshots(spark, str(tmp_path / "store")), str(tmp_path / "in"), [True]
    spark.range(5).write.parquet(folder)

    def rebuild(df):
        if broken[0]:
            raise ValueError("not now")
        return df

    start = lambda: S.refresh(spark.readStream.schema("id bigint").parquet(folder), rebuild, store, str(tmp_path / "cp"), once=True)
    with pytest.raises(Exception, match="not now"):
        start().awaitTermination(60)
    assert store.revision() is None
    broken[0] = False
    start().awaitTermination(60)
    assert store.read().count() == 5


def test_entry_is_whole_without_the_subpackage(tmp_path):
    """In a copy without the corpus operators the entry point still has the others."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and 'metric_pagerank' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "", "PYTHONPATH": str(tmp_path)})
