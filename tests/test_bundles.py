"""Concept bundles, line records, CSR rows, merge decisions and the spectral layout on small inputs."""

from graphloom.graph import from_pairs
from graphloom.operators import layout, versions
from graphloom.sources import bundles, files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_relative_links():
    at = lambda link: bundles.relative("a/b/c.md", link)
    assert at("d.md") == "a/b/d" and at("../d.md#x") == "a/d" and at("/x/y.md") == "x/y" and at("sp%20ace.md") == "a/b/sp ace"
    assert at("../../../d.md") is None and at("d.txt") is None and at("https://h/d.md") is None


def test_concepts(spark):
    head = "---\ntype: page\n{}---\n"
    notes = [
        ("a/one.md", head.format("title: One\ntags: [z, y, z]\nverified: [human:me]\n") + "[two](two.md) ![img](two.md) [gone](gone.md) [w](https://h/x/two?q=1)"),
        ("a/two.md", head.format("source_url: https://k/x/two\nverified: [bot]\nstatus: draft\n") + "[self](two.md) [n](https://none/a/b)"),
        ("a/index.md", "no concept"),
        ("bad.md", "no frontmatter"),
        ("worse.md", head.format("status: odd\n")),
        ("tags.md", head.format("tags: x\n")),
        ("none.md", "---\ntitle: x\n---\n"),
    ]
    nodes, edges, lost, rejected = bundles.concepts(spark.createDataFrame([*notes, ("null.md", None)], "path string, text string"))
    assert rows(nodes, "id", "title", "status", "trust") == [("a/one", "One", "stable", "human-reviewed"), ("a/two", "two", "draft", "machine-confirmed")]
    assert rows(nodes.filter("id = 'a/one'"), "tags") == [(["y", "z"],)]
    assert rows(edges, "src", "dst") == [("a/one", "a/two")]
    assert rows(lost, "src", "link") == [("a/one", "a/gone"), ("a/two", "https://none/a/b")]
    assert rows(rejected, "id", "problem") == [("bad", "no frontmatter"), ("none", "no type"), ("null", "no frontmatter"), ("tags", "tags are no list"), ("worse", "unknown status")]


def test_records(spark):
    lines = ["N|a|A|x|t, s,t|k=v;m=n=o", "N|b|B|x||", "E|a|b", "E|a|b", "E|a|zz", "", "  ", "Q|x", "N|c|C|x||broken", "N|d|1|x||", "N|d|2|x||"]
    nodes, edges, lost, rejected = bundles.records(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(nodes, "id", "tags") == [("a", ["s", "t"]), ("b", [])]
    assert nodes.filter("id = 'a'").first()["properties"] == {"k": "v", "m": "n=o"}
    assert rows(edges, "src", "dst") == [("a", "b")] and rows(lost, "dst") == [("zz",)]
    assert rows(rejected, "line") == [("N|c|C|x||broken",), ("N|d|1|x||",), ("N|d|2|x||",), ("Q|x",)]


def test_csr_rows_keep_parallel_edges(spark):
    g = from_pairs(spark, 4, [(0, 1), (0, 1), (2, 2), (1, 3)])
    assert rows(files.csr_rows(g), "idx", "start", "targets") == [(0, 0, [1, 1]), (1, 2, [0, 0, 3]), (2, 5, []), (3, 5, [1])]


def test_merge_kinds(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], "commit string, parent string")
    kind = lambda x, y: versions.merge_kind(parents, x, y)
    assert kind("c", "d") == ("three-way", "b") and kind("c", "b") == ("up-to-date", "b")
    assert kind("a", "d") == ("fast-forward", "a") and kind("c", "z") == ("unrelated", None)


def test_spectral_layout_separates_cliques(spark):
    clique = [(a, b) for a in range(4) for b in range(a)]
    g = from_pairs(spark, 8, [*clique, *((a + 4, b + 4) for a, b in clique), (0, 4)])
    x = dict(rows(layout.spectral(g, 8), "idx", "x"))
    assert {x[i] > 0 for i in range(4)} != {x[i] > 0 for i in range(4, 8)}
    assert len({x[i] > 0 for i in range(4)}) == 1 and round(max(map(abs, x.values())), 6) == 100
    assert abs(sum(x.values())) < 1e-6


def test_lists_of_commas(spark):
    from pyspark.sql import functions as F

    from graphloom.functions import text

    assert spark.range(1).select(text.csv_list(F.lit(" 0a0 , 1,, b1 "))).first()[0] == ["0a0", "1", "b1"]
