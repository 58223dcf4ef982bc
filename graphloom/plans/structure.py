"""Registered queries over the hierarchy of the tables, links between pages, lenses, partitions, layouts, commits and frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..graph import Graph, build, integrity
from ..operators import analytics as A
from ..operators import filters, layout, lens, partition, search, versions
from ..sources import bundles, files, links, notes
from ..streaming import snapshots
from .queries import _GRID, G, _t, documents_index, query, users


def hierarchy(spark: SparkSession, d: str) -> Graph:
    """Regions, nations, customers and suppliers in this order; each but regions points to what it lies in."""

    def rows(table: str, key: str, place: int, up: str | None, parent: str) -> DataFrame:
        name = lambda t, c: F.concat(F.lit(f"tpch:main:{t}/"), F.col(c).cast("string"))
        above = name(up, parent) if up else F.lit(None).cast("string")
        return _t(spark, d, table).select(name(table, key).alias("id"), F.lit(place).alias("place"), F.col(key).cast("long").alias("key"), above.alias("up"))

    all_ = rows("region", "r_regionkey", 0, None, "").unionAll(rows("nation", "n_nationkey", 1, "region", "n_regionkey"))
    all_ = all_.unionAll(rows("customer", "c_custkey", 2, "nation", "c_nationkey")).unionAll(rows("supplier", "s_suppkey", 3, "nation", "s_nationkey"))
    edges = all_.filter("up is not null").select(F.col("id").alias("src"), F.col("up").alias("dst"))
    return build(all_.select("id", "place", "key"), edges, "place", "key")


H = """h AS (SELECT 'tpch:main:region/' || r_regionkey AS id, 0 AS place, r_regionkey::BIGINT AS key, NULL AS up, r_regionkey AS root FROM region
 UNION ALL SELECT 'tpch:main:nation/' || n_nationkey, 1, n_nationkey, 'tpch:main:region/' || n_regionkey, n_regionkey FROM nation
 UNION ALL SELECT 'tpch:main:customer/' || c_custkey, 2, c_custkey, 'tpch:main:nation/' || c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
 UNION ALL SELECT 'tpch:main:supplier/' || s_suppkey, 3, s_suppkey, 'tpch:main:nation/' || s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
 hn AS (SELECT *, row_number() OVER (ORDER BY place, key) - 1 AS idx FROM h)"""


@query(f"WITH {H}, i AS (SELECT up AS id, count(*) AS k FROM h WHERE up IS NOT NULL GROUP BY 1) SELECT hn.id, idx, coalesce(k, 0) + CASE WHEN up IS NULL THEN 0 ELSE 1 END AS degree FROM hn LEFT JOIN i ON i.id = hn.id")
def graph_hierarchy(spark, d):
    g = hierarchy(spark, d)
    return g.nodes.select("id", "idx").join(A.degrees(g).select("idx", "degree"), "idx").select("id", "idx", "degree")


@query(f"WITH {H} SELECT idx, dense_rank() OVER (ORDER BY f) - 1 AS wcc FROM (SELECT idx, min(idx) OVER (PARTITION BY root) AS f FROM hn)")
def metric_wcc(spark, d):
    return A.wcc(hierarchy(spark, d))


@query(f"WITH {H} SELECT count(*) AS n_nodes, count(DISTINCT root) AS num_wcc, count(DISTINCT place) AS num_communities, count(up) AS n_edges FROM hn")
def graph_summary(spark, d):
    g = hierarchy(spark, d)
    return A.summary(A.wcc(g).join(g.nodes.select("idx", F.col("place").alias("community")), "idx"), g)


@query("SELECT 'repeated id' AS rule, 0::BIGINT AS n UNION ALL SELECT 'missing end', count_if(n_regionkey > 2) FROM nation UNION ALL SELECT 'malformed id', 1")
def graph_integrity(spark, d):
    """Nations and three of the regions, and one id without a namespace."""
    name = lambda t, c: F.concat(F.lit(f"tpch:main:{t}/"), F.col(c).cast("string"))
    nation = _t(spark, d, "nation")
    nodes = nation.select(name("nation", "n_nationkey").alias("id")).unionAll(_t(spark, d, "region").filter("r_regionkey <= 2").select(name("region", "r_regionkey")))
    nodes = nodes.unionAll(spark.range(1).select(F.lit("alone").alias("id")))
    return integrity(nodes, nation.select(name("nation", "n_nationkey").alias("src"), name("region", "n_regionkey").alias("dst")))


@query(f"""WITH {G}, o AS (SELECT DISTINCT dst AS idx FROM g WHERE src = 7 AND dst <> 7), i AS (SELECT DISTINCT src AS idx FROM g WHERE dst = 7 AND src <> 7)
 SELECT idx, CASE WHEN o.idx IS NOT NULL AND i.idx IS NOT NULL THEN 'Both' WHEN o.idx IS NOT NULL THEN 'Out' ELSE 'In' END AS direction FROM o FULL JOIN i USING (idx)""")
def graph_neighbourhood_users(spark, d):
    return users(spark, d).neighbourhood(7)


def _quarters(g: Graph) -> DataFrame:
    return g.nodes.select("idx", (F.col("idx") % 4).alias("part"))


@query(f"""WITH {G}, c AS (SELECT src, dst FROM nb WHERE src % 4 <> dst % 4)
 SELECT 'ghost' AS kind, src % 4 AS part, dst AS idx FROM c GROUP BY ALL UNION ALL SELECT 'boundary', src % 4, src FROM c GROUP BY ALL""")
def partition_tables(spark, d):
    g = users(spark, d)
    ghosts, edge, _ = A.boundary(g, _quarters(g))
    return ghosts.select(F.lit("ghost").alias("kind"), "part", "idx").unionAll(edge.select(F.lit("boundary").alias("kind"), "part", "idx"))


@query(f"WITH {G} SELECT count(*) AS edge_cut FROM nb WHERE src < dst AND src % 4 <> dst % 4")
def partition_edge_cut(spark, d):
    g = users(spark, d)
    return A.boundary(g, _quarters(g))[2]


@query(f"WITH {G} SELECT least(src % 4, dst % 4) AS src, greatest(src % 4, dst % 4) AS dst, count(*) AS weight FROM g WHERE src % 4 <> dst % 4 GROUP BY 1, 2")
def partition_contract(spark, d):
    g = users(spark, d)
    return partition.contract(g, _quarters(g))


@query()
def partition_regions(spark, d):
    return partition.regions(users(spark, d), 4)


@query()
def partition_matching(spark, d):
    return partition.matching(users(spark, d))


@query("""SELECT 'o_orderstatus' AS field, o_orderstatus AS value, o_orderkey AS idx FROM orders UNION ALL SELECT 'o_orderpriority', trim(o_orderpriority), o_orderkey FROM orders""")
def facet_members(spark, d):
    return filters.facet_members(_t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey").select("field", "value", "idx")


@query("""WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS tag FROM part), k AS (SELECT tag, count(*) AS degree FROM t GROUP BY 1) SELECT p_partkey, tag, degree FROM t JOIN k USING (tag)""")
def facet_tag_degrees(spark, d):
    tags = _t(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_type", " "))).alias("tag"))
    return tags.join(tags.groupBy("tag").agg(F.count("*").alias("degree")), "tag").select("p_partkey", "tag", "degree")


@query("SELECT q, list_sort(x)[floor((len(x) - 1) * q)::BIGINT + 1] AS value FROM (SELECT list(o_totalprice) AS x FROM orders), (SELECT unnest([0.5::DOUBLE, 0.99::DOUBLE]) AS q)")
def metric_nearest_rank(spark, d):
    return numeric.nearest_rank(_t(spark, d, "orders"), "o_totalprice", 0.5, 0.99).select("q", "value")


@query(f"""WITH {H}, c AS (SELECT n_regionkey, min(idx) AS f FROM hn JOIN nation ON hn.id = 'tpch:main:nation/' || n_nationkey GROUP BY 1)
 SELECT idx, class, class % 3 AS hue, class % 5 AS shape FROM (SELECT idx, dense_rank() OVER (ORDER BY f) - 1 AS class FROM hn JOIN c ON n_regionkey = root)""")
def lens_classes(spark, d):
    """The region of each node's component as its class."""
    g = hierarchy(spark, d)
    root = A.components(g).filter("component is not null")
    # Components begin with a region, so numbering by first node numbers regions.
    classes = lens.dictionary(root, "component")
    hue = lens.palette(F.col("class"), ["0", "1", "2"]).cast("long").alias("hue")
    return classes.select("idx", "class", hue, lens.shape(F.col("class")).cast("long").alias("shape"))


@query("""SELECT c_custkey, round(CASE WHEN hi = lo THEN 4 ELSE 2 + 8 * sqrt((c_acctbal - lo) / (hi - lo)) END, 9) AS size FROM customer, (SELECT max(c_acctbal) AS hi, min(c_acctbal) AS lo FROM customer)""")
def lens_sizes(spark, d):
    return lens.sizes(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("size", 9).alias("size"))


@query("""WITH t AS (SELECT c_custkey, (c_acctbal - lo) / greatest(hi - lo, 1e-6::DOUBLE) AS t FROM customer, (SELECT max(c_acctbal) AS hi, min(c_acctbal) AS lo FROM customer))
 SELECT c_custkey, round(CASE WHEN t < 0.5 THEN 0.2::DOUBLE + 0.4::DOUBLE * t * 2 ELSE 0.6::DOUBLE + 0.4::DOUBLE * (t * 2 - 1) END, 9) AS red FROM t""")
def lens_gradient(spark, d):
    out = lens.gradient(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", [(0.2, 0, 0), (0.6, 0, 0), (1.0, 0, 0)])
    return out.select("c_custkey", F.round("red", 9).alias("red"))


@query(f"WITH {G} SELECT src, dst, CASE WHEN src % 5 = dst % 5 THEN src % 5 END AS class, count(*) AS k FROM g GROUP BY ALL")
def lens_edge_classes(spark, d):
    g = users(spark, d)
    return lens.edge_classes(g, g.nodes.select("idx", (F.col("idx") % 5).alias("class"))).groupBy("src", "dst", "class").agg(F.count("*").alias("k"))


@query("""WITH p AS (SELECT c_nationkey AS focus, c_custkey AS idx, abs(c_acctbal) AS r, (1 + c_custkey % 7)::DOUBLE AS d FROM customer),
 q AS (SELECT *, greatest(least(4, count(*) OVER (PARTITION BY focus) // 2), 1) AS p, row_number() OVER (PARTITION BY focus ORDER BY r, idx) AS i FROM p),
 m AS (SELECT a.focus, a.idx, a.r, a.i, greatest(avg(b.d), 1e-6) AS m FROM q a JOIN q b ON b.focus = a.focus AND b.i BETWEEN a.i - a.p AND a.i + a.p - 1 GROUP BY ALL),
 s AS (SELECT *, greatest(r - lag(r, 1, 0) OVER (PARTITION BY focus ORDER BY i), 0) / m AS s FROM m), f AS (SELECT *, sum(s) OVER (PARTITION BY focus ORDER BY i) AS f FROM s)
 SELECT focus, idx, round(f * CASE WHEN max(f) OVER w > 0 THEN max(r) OVER w / max(f) OVER w ELSE 1 END, 6) AS radius FROM f WINDOW w AS (PARTITION BY focus)""")
def fisheye_distort(spark, d):
    points = _t(spark, d, "customer").select(F.col("c_nationkey").alias("focus"), F.col("c_custkey").alias("idx"), F.abs("c_acctbal").alias("r"), (1 + F.col("c_custkey") % 7).cast("double").alias("d"))
    return lens.distort(points).select("focus", "idx", F.round("radius", 6).alias("radius"))


@query("""SELECT focus, idx, floor(log2((k - 1) / 4 + 1))::INT AS level FROM (SELECT c_nationkey AS focus, c_custkey AS idx, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 13 END NULLS LAST, c_custkey) AS k FROM customer)""")
def fisheye_levels(spark, d):
    c = _t(spark, d, "customer")
    near = c.select(F.col("c_nationkey").alias("focus"), F.col("c_custkey").alias("idx"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 13).alias("distance"))
    return lens.fill_levels(near, 4)


@query("SELECT o_orderkey AS idx, round(cos(o_orderkey * 2 * pi() / n) * 100, 6) + 0.0::DOUBLE AS x, round(sin(o_orderkey * 2 * pi() / n) * 100, 6) + 0.0::DOUBLE AS y FROM orders, (SELECT count(*) AS n FROM orders)")
def layout_circle(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))
    return layout.circle(o, o.count()).select("idx", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query("""WITH o AS (SELECT o_orderkey AS idx, 1 - 2 * (o_orderkey + 0.5::DOUBLE) / n AS lat FROM orders, (SELECT count(*) + 1 AS n FROM orders))
 SELECT idx, round(sqrt(1 - lat * lat) * 100 * cos(idx * (pi() * (3 - sqrt(5)))), 5) + 0.0::DOUBLE AS x, round(lat * 100, 6) AS y FROM o""")
def layout_sphere(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))
    return layout.sphere(o, o.count() + 1).select("idx", (F.round("x", 5) + 0.0).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH m AS (SELECT c_custkey AS idx, c_nationkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n, dense_rank() OVER (ORDER BY c_nationkey) - 1 AS o FROM customer),
 a AS (SELECT *, max(o) OVER () + 1 AS a FROM m) SELECT idx, round(250 * cos(o * 2 * pi() / a) + 100 * cos(k * 2 * pi() / n), 5) + 0.0::DOUBLE AS x, round(250 * sin(o * 2 * pi() / a) + 100 * sin(k * 2 * pi() / n), 5) + 0.0::DOUBLE AS y FROM a""")
def layout_clusters(spark, d):
    m = _t(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("cluster"))
    return layout.clusters(m).select("idx", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))


@query()
def layout_hilbert(spark, d):
    return layout.hilbert(spark.range(4096).withColumnRenamed("id", "idx"), 4096)


@query()
def layout_ball(spark, d):
    return layout.ball(users(spark, d).nodes.select("idx"))


@query(f"WITH {H} SELECT idx, (CASE place WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::INT AS layer FROM hn")
def layout_layers(spark, d):
    return layout.layered(hierarchy(spark, d)).select("idx", "layer")


@query("""SELECT c_nationkey AS nation, round(avg(c_acctbal), 6) AS cx, round(sqrt(greatest(avg(c_acctbal * c_acctbal) + avg(k * k) - avg(c_acctbal) ** 2 - avg(k) ** 2, 0)), 4) AS gyration FROM (SELECT *, (c_custkey % 100)::DOUBLE AS k FROM customer) GROUP BY 1""")
def layout_gyration(spark, d):
    points = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return layout.spread(points, "nation").select("nation", F.round("cx", 6).alias("cx"), F.round("gyration", 4).alias("gyration"))


@query("""WITH p AS (SELECT s_suppkey AS i, (s_suppkey % 10)::DOUBLE AS x, (s_suppkey // 10 % 10)::DOUBLE AS y, (s_suppkey // 100)::DOUBLE AS z FROM supplier)
 SELECT a.i AS idx, b.i AS idx2, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 9) AS distance FROM p a JOIN p b ON a.i < b.i AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 1.5""")
def layout_contacts(spark, d):
    k = F.col("s_suppkey")
    at = {"x": k % 10, "y": F.floor(k / 10) % 10, "z": F.floor(k / 100)}
    points = _t(spark, d, "supplier").select(k.alias("idx"), *(v.cast("double").alias(c) for c, v in at.items()), F.lit(0.75).alias("r"))
    return layout.contacts(points, 1.0, 1.5).select("idx", "idx2", F.round("distance", 9).alias("distance"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages) SELECT page_id AS src, count(*) AS links, count(DISTINCT url) AS targets FROM l GROUP BY 1""")
def source_page_links(spark, d):
    found = _t(spark, d, "pages").select(F.col("page_id").alias("src"), F.explode(links.hrefs(F.col("html"))).alias("url"))
    return found.groupBy("src").agg(F.count("*").alias("links"), F.countDistinct("url").alias("targets"))


@query("""WITH p AS (SELECT page_id AS idx, trim(split_part(url, '#', 1)) AS u, list_filter(string_split(split_part(regexp_extract(trim(split_part(url, '#', 1)), '://(.*)$', 1), '?', 1), '/'), lambda x: x <> '') AS s FROM pages),
 k AS (SELECT idx, u AS key FROM p UNION ALL SELECT idx, s[-2] || '/' || s[-1] FROM p WHERE len(s) >= 2 UNION ALL SELECT idx, s[-1] FROM p WHERE len(s) >= 2 AND s[-2] = 'browse')
 SELECT key, min(idx) AS idx FROM k WHERE key <> '' GROUP BY 1""")
def source_url_index(spark, d):
    return links.url_index(_t(spark, d, "pages"), "page_id")


@query("""WITH p AS (SELECT page_id, trim(split_part(url, '#', 1)) AS u FROM pages), i AS (SELECT u, min(page_id) AS dst FROM p GROUP BY 1) SELECT DISTINCT page_id AS src, dst FROM p JOIN i USING (u)""")
def source_resolve(spark, d):
    """Each page's URL with another fragment leads to the first page known by it."""
    pages = _t(spark, d, "pages")
    asked = pages.select(F.col("page_id").alias("src"), F.concat(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("#part")).alias("url"))
    return links.resolve(asked, links.url_index(pages, "page_id"))[0]


@query("""SELECT l_suppkey AS src, l_partkey AS dst FROM (SELECT least(l_suppkey, l_partkey) AS u, greatest(l_suppkey, l_partkey) AS v, min({'a': l_suppkey, 'b': l_partkey}) AS e FROM lineitem WHERE l_suppkey <> l_partkey AND l_returnflag IN ('A', 'R') AND l_suppkey IN (SELECT p_partkey FROM part) AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1, 2), LATERAL (SELECT e.a AS l_suppkey, e.b AS l_partkey)""")
def source_edge_list(spark, d):
    edges = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    return links.edge_list(edges, _t(spark, d, "part").select(F.col("p_partkey").alias("id")), ["A", "R"])


@query("SELECT 'tpch:copy:' || c_custkey AS id, 'tpch:copy:' || (c_custkey // 2) AS up FROM customer")
def source_renamed(spark, d):
    name = lambda c: F.concat(F.lit("tpch:main:"), c.cast("string"))
    rows = _t(spark, d, "customer").select(name(F.col("c_custkey")).alias("id"), name(F.floor(F.col("c_custkey") / 2)).alias("up"))
    return notes.renamed(rows, ["id", "up"], "tpch:main:", "tpch:copy:")


@query("""WITH t AS (SELECT doc_id, trim(regexp_extract(coalesce(text, ''), '^([^\n]*)', 1), ' ') AS l FROM documents), h AS (SELECT *, left(l, 40) AS h, regexp_extract(left(l, 40), '^(.*) [^ ]*$', 1) AS u FROM t)
 SELECT doc_id, CASE WHEN l = '' THEN 'Document ' || left(doc_id::VARCHAR, 8) WHEN length(l) <= 40 THEN l WHEN contains(h, ' ') AND octet_length(encode(u)) > 20 THEN u || '…' ELSE h || '…' END AS title FROM h""")
def scalar_titles(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.title(F.col("text"), F.col("doc_id").cast("string"), 40, "Document").alias("title"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe, left(regexp_extract(url, '([^/]*)$', 1), 24) AS short FROM pages""")
def scalar_escaped(spark, d):
    return _t(spark, d, "pages").select("page_id", text.escaped(F.col("html")).alias("safe"), text.short_id(F.col("url")).alias("short"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') = '7' AS skipped FROM events")
def scalar_pointer(spark, d):
    return _t(spark, d, "events").select("event_id", text.pointer(F.col("props"), "/k").alias("k"), text.skips(F.col("props"), "/k", "7", False).alias("skipped"))


@query("""WITH w AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term <> ''),
 l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS a FROM l), p AS (SELECT doc_id, count(*) AS tf FROM w WHERE term = 'the' GROUP BY 1), f AS (SELECT count(*) AS df FROM p)
 SELECT doc_id AS idx, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)), 9) AS score FROM p JOIN l USING (doc_id), s, f ORDER BY 2 DESC, 1 LIMIT 50""")
def search_ranked(spark, d):
    """The 50 best documents for one word: the limit is the feature."""
    return search.rank(documents_index(spark, d), "the", {"text"}).select("idx", F.round("score", 9).alias("score"))


@query()
def search_snippets(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), ["the", "de"]).alias("snippet")).filter("snippet is not null")


_HEAP = "p AS (SELECT c_custkey::VARCHAR AS c, (c_custkey // 2)::VARCHAR AS p FROM customer WHERE c_custkey > 1)"


def _heap(spark, d) -> DataFrame:
    """A history in which the parent of commit k is k // 2."""
    c = _t(spark, d, "customer").filter("c_custkey > 1")
    return c.select(F.col("c_custkey").cast("string").alias("commit"), F.floor(F.col("c_custkey") / 2).cast("string").alias("parent"), F.lit(0).alias("nth"))


@query(f"WITH RECURSIVE {_HEAP}, a AS (SELECT '149' AS commit, 0 AS depth UNION SELECT p, depth + 1 FROM a JOIN p ON c = commit) SELECT * FROM a")
def version_ancestors(spark, d):
    return versions.ancestors(_heap(spark, d), "149").select("commit", F.col("depth").cast("int").alias("depth"))


@query(f"""WITH RECURSIVE {_HEAP}, a AS (SELECT '149' AS commit, 0 AS depth UNION SELECT p, depth + 1 FROM a JOIN p ON c = commit), b AS (SELECT '75' AS commit, 0 AS depth_b UNION SELECT p, depth_b + 1 FROM b JOIN p ON c = commit)
 SELECT commit, depth, depth_b FROM a JOIN b USING (commit) ORDER BY 2, 3, 1 LIMIT 1""")
def version_common_ancestor(spark, d):
    return versions.common_ancestor(_heap(spark, d), "149", "75").select("commit", "depth", "depth_b")


@query(f"""WITH RECURSIVE {_HEAP}, a AS (SELECT '149' AS commit, 0 AS depth UNION SELECT p, depth + 1 FROM a JOIN p ON c = commit), b AS (SELECT '75' AS commit UNION SELECT p FROM b JOIN p ON c = commit)
 SELECT commit, depth FROM a WHERE commit NOT IN (SELECT commit FROM b)""")
def version_replayed(spark, d):
    return versions.replayed(_heap(spark, d), "149", "75").select("commit", "depth")


@query(f"WITH RECURSIVE {_HEAP}, a AS (SELECT '149' AS commit, 0 AS place UNION SELECT p, place + 1 FROM a JOIN p ON c = commit) SELECT commit, place FROM a WHERE place < 6")
def version_first_parents(spark, d):
    return versions.first_parent_log(_heap(spark, d), "149", 6).select("commit", "place")


@query("SELECT c_custkey::VARCHAR AS commit, floor(log2(c_custkey))::INT AS level FROM customer WHERE c_custkey >= 1")
def version_topological(spark, d):
    commits = _t(spark, d, "customer").filter("c_custkey >= 1").select(F.col("c_custkey").cast("string").alias("commit"))
    return versions.topological(commits, _heap(spark, d).filter("parent <> '0'")).select("commit", "level")


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 = 0 THEN 'o' WHEN c_custkey % 4 = 1 THEN 't' WHEN c_custkey % 4 = 2 THEN NULL ELSE 'm' END AS body, c_custkey % 4 <> 3 AS clean FROM customer""")
def version_resolve(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 4).alias("k"))
    merged = c.select("id", F.lit("m").alias("body"), F.lit(False).alias("clean"), F.lit("b").alias("base"), F.lit("o").alias("ours"), F.lit("t").alias("theirs"))
    choices = c.filter("k < 3").select("id", F.element_at(F.array(F.lit("ours"), F.lit("theirs"), F.lit("deleted")), (F.col("k") + 1).cast("int")).alias("choice"), F.lit(None).cast("string").alias("body"))
    return versions.resolve(merged, choices).select("id", "body", "clean")


def _frames(spark, d) -> DataFrame:
    return _t(spark, d, "events").select(F.col("user_id").alias("idx"), F.col("event_id").alias("frame"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))


@query("""WITH n AS (SELECT user_id AS idx, event_id AS frame, value, row_number() OVER w - 1 AS n, value - lag(value) OVER w AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT idx, frame, n // 16 AS run, n % 16 = 0 AS keyframe, round(CASE WHEN n % 16 = 0 THEN value ELSE delta END, 6) AS x FROM n""")
def stream_keyframes(spark, d):
    return snapshots.keyframed(_frames(spark, d), 16).select("idx", "frame", "run", "keyframe", F.round("x", 6).alias("x"))


@query("SELECT user_id AS idx, event_id AS frame, round(value, 6) AS x FROM events")
def stream_restored(spark, d):
    return snapshots.restored(snapshots.keyframed(_frames(spark, d), 16)).select("idx", "frame", F.round("x", 6).alias("x"))


@query("""WITH m AS (SELECT event_id // 100 AS frame, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY event_id // 100)) AS d FROM (SELECT user_id, event_id // 100 * 100 AS event_id, avg(value) AS v FROM events GROUP BY 1, 2))
 SELECT frame, round(max(coalesce(d, 0)), 6) AS most, round(avg(coalesce(d, 0)), 6) AS mean FROM m GROUP BY 1""")
def stream_displacement(spark, d):
    steps = _frames(spark, d).withColumn("frame", F.floor(F.col("frame") / 100)).groupBy("idx", "frame").agg(*(F.avg(c).alias(c) for c in "xyz"))
    return snapshots.displacement(steps).select("frame", F.round("most", 6).alias("most"), F.round("mean", 6).alias("mean"))


@query("SELECT user_id AS idx, max(event_id) AS frame, arg_max(value, event_id) AS x FROM events WHERE event_type = 'click' GROUP BY 1")
def stream_live_frames(spark, d):
    """Frames of the live revision: those of clicks."""
    e = _t(spark, d, "events").select(F.when(F.col("event_type") == "click", 2).otherwise(1).alias("revision"), F.lit(1).alias("generation"), F.col("event_id").alias("frame"), F.col("user_id").alias("idx"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return snapshots.latest_frames(e, 2, 1).select("idx", "frame", "x")


@query("SELECT event_id AS seq, event_type FROM events, (SELECT max(event_id) AS top FROM events) WHERE event_id >= 50 AND event_id > top - 1024")
def stream_since(spark, d):
    return snapshots.since(_t(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), 50)


@query(f"""WITH {G}, {_GRID}, p AS (SELECT a.src AS centre, a.dst AS a, b.dst AS b, row_number() OVER (PARTITION BY a.src ORDER BY a.dst, b.dst) - 1 AS k, count(*) OVER (PARTITION BY a.src) AS m FROM nb a JOIN nb b ON b.src = a.src AND a.dst < b.dst),
 q AS (SELECT p.*, u.x - o.x AS ux, u.y - o.y AS uy, v.x - o.x AS vx, v.y - o.y AS vy FROM p JOIN pt o ON o.idx = centre JOIN pt u ON u.idx = a JOIN pt v ON v.idx = b WHERE k % greatest(m // 64, 1) = 0)
 SELECT centre, a, b, round(acos(greatest(-1, least(1, (ux * vx + uy * vy) / greatest(sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)), 1e-12)))) * 180 / pi(), 3) AS degrees FROM q""")
def layout_angles(spark, d):
    g = users(spark, d)
    return layout.angles(g, layout.grid(g.nodes, g.nodes.count())).select("centre", "a", "b", F.round(F.col("angle") * 180 / math.pi, 3).alias("degrees"))


@query(f"WITH {G}, k AS (SELECT src AS idx, count(*) AS n FROM adj GROUP BY 1), a AS (SELECT n.idx, coalesce(k.n, 0) AS size FROM n LEFT JOIN k USING (idx)), t AS (SELECT src AS idx, string_agg(dst, ',' ORDER BY dst) AS targets FROM adj GROUP BY 1) SELECT idx, sum(size) OVER (ORDER BY idx)::BIGINT - size AS start, size, coalesce(targets, '') AS targets FROM a LEFT JOIN t USING (idx)")
def sink_csr_rows(spark, d):
    return files.csr_rows(users(spark, d)).select("idx", "start", F.size("targets").cast("long").alias("size"), F.array_join(F.array_sort("targets"), ",").alias("targets"))


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS title, 's' || s_nationkey AS kind, s_acctbal::VARCHAR AS balance FROM supplier")
def source_records(spark, d):
    """Suppliers written as lines and read back."""
    s, text_of = _t(spark, d, "supplier"), lambda c: F.col(c).cast("string")
    line = F.concat_ws("|", F.lit("N"), text_of("s_suppkey"), F.col("s_name"), F.concat(F.lit("s"), text_of("s_nationkey")), F.lit(""), F.concat(F.lit("balance="), text_of("s_acctbal")))
    return bundles.records(s.select(line.alias("value")))[0].select("id", "title", "kind", F.col("properties")["balance"].alias("balance"))


@query("SELECT 'p/' || p_partkey AS src, 'p/' || (p_partkey + 1) AS dst FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)")
def source_concepts(spark, d):
    """Parts as concept files, each with a relative link to the next."""
    key = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("---\ntype: part\ntags: [a, b]\n---\nSee [next](./"), (F.col("p_partkey") + 1).cast("string"), F.lit(".md#top)."))
    files_ = _t(spark, d, "part").select(F.concat(F.lit("p/"), key, F.lit(".md")).alias("path"), body.alias("text"))
    return bundles.concepts(files_)[1]


@query()
def layout_spectral(spark, d):
    return layout.spectral(users(spark, d))
