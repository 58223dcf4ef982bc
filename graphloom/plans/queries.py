"""Registered queries of the graph engine over a folder of tables, each beside its SQL where SQL expresses it.

The graph of users: a node per user_id of `events`, an edge from the user of each event to that of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..graph import Graph, build
from ..operators import analytics as A
from ..operators import filters, forces, layout, search, versions
from .tables import fresh, kept

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of users, stored once for an application and state of the table."""
    return kept(spark, "users", f"{sf_dir}/events.parquet", lambda: _users(spark, sf_dir))


def _users(spark: SparkSession, sf_dir: str) -> Graph:
    e = _t(spark, sf_dir, "events").select("event_id", "user_id")
    pairs = e.select((F.col("event_id") + 1).alias("event_id"), F.col("user_id").alias("src")).join(e.withColumnRenamed("user_id", "dst"), "event_id").select("src", "dst")
    g = build(e.select(F.col("user_id").alias("id")).distinct(), pairs, "id")
    return Graph(A.settle(g.nodes, "nodes"), A.settle(g.edges, "edges"))


G = """e AS (SELECT a.user_id AS s, b.user_id AS d FROM events a JOIN events b ON b.event_id = a.event_id + 1),
 n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT user_id AS id FROM events)),
 g AS (SELECT x.idx AS src, y.idx AS dst FROM e JOIN n x ON x.id = e.s JOIN n y ON y.id = e.d),
 adj AS (SELECT src, dst FROM g WHERE src <> dst UNION ALL SELECT dst, src FROM g WHERE src <> dst),
 nb AS (SELECT DISTINCT src, dst FROM adj)"""


@query(f"WITH {G} SELECT idx, id FROM n")
def graph_nodes(spark, d):
    return users(spark, d).nodes.select("idx", "id")


@query(f"WITH {G} SELECT src, dst, count(*) AS k FROM adj GROUP BY 1, 2")
def graph_adjacency(spark, d):
    return users(spark, d).adjacency().groupBy("src", "dst").agg(F.count("*").alias("k"))


@query(f"""WITH {G}, i AS (SELECT dst AS idx, count(*) AS k FROM g GROUP BY 1), o AS (SELECT src AS idx, count(*) AS k FROM g GROUP BY 1)
 SELECT n.idx, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree, coalesce(i.k, 0) AS indegree, coalesce(o.k, 0) AS outdegree FROM n LEFT JOIN i USING (idx) LEFT JOIN o USING (idx)""")
def metric_degrees(spark, d):
    return A.degrees(users(spark, d))


def _rank_sql(rounds: int, links: str) -> str:
    out = f"WITH {G}, l AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM {links} GROUP BY 1, 2), c AS (SELECT count(*) AS n FROM n), r0 AS (SELECT idx, 1.0::DOUBLE / c.n AS r FROM n, c)"
    for k in range(rounds):
        out += f""", q{k} AS MATERIALIZED (SELECT l.dst AS idx, sum(l.share * r.r) AS r FROM l JOIN r{k} r ON r.idx = l.src GROUP BY 1),
 z{k} AS (SELECT coalesce(sum(r), 0) AS r FROM r{k} WHERE idx NOT IN (SELECT src FROM l)),
 r{k + 1} AS MATERIALIZED (SELECT n.idx, 0.15 / c.n + 0.85 * (coalesce(q{k}.r, 0) + z{k}.r / c.n) AS r FROM n CROSS JOIN c CROSS JOIN z{k} LEFT JOIN q{k} USING (idx))"""
    return out + f" SELECT idx, round(r, 10) AS pagerank FROM r{rounds}"


@query(_rank_sql(50, "g"))
def metric_pagerank(spark, d):
    return A.pagerank(users(spark, d)).select("idx", F.round("pagerank", 10).alias("pagerank"))


@query(_rank_sql(50, "adj"))
def metric_pagerank_symmetric(spark, d):
    return A.pagerank(users(spark, d), symmetric=True).select("idx", F.round("pagerank", 10).alias("pagerank"))


@query("""WITH RECURSIVE n AS (SELECT 'c' || c_custkey AS id, c_custkey AS k FROM customer)
 SELECT id, 'c' || min(c_custkey) OVER (PARTITION BY c_nationkey) AS root FROM (SELECT 'c' || c_custkey AS id, c_custkey, c_nationkey FROM customer)""")
def metric_components(spark, d):
    """Customers linked to the next customer of their nation: components are nations."""
    from pyspark.sql import Window

    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    nxt = F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    edges = c.select(F.col("c_custkey").alias("src"), nxt.alias("dst")).filter("dst is not null")
    g = build(c.select(F.col("c_custkey").alias("id")), edges, "id")
    roots = A.components(g)
    names = g.nodes.select(F.col("idx").alias("component"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("root"))
    return roots.join(g.nodes, "idx").join(names, "component").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "root")


@query(f"""WITH RECURSIVE {G}, b AS (SELECT 0::BIGINT AS idx, 0 AS distance UNION SELECT nb.dst, b.distance + 1 FROM b JOIN nb ON nb.src = b.idx WHERE b.distance < 40)
 SELECT n.idx, min(b.distance) AS distance FROM n LEFT JOIN b USING (idx) GROUP BY 1""")
def metric_bfs(spark, d):
    """Hops from the first node; the SQL's bound is beyond any distance of this graph."""
    return A.bfs(users(spark, d), 0).select("idx", F.col("distance").cast("int").alias("distance"))


_STRENGTH = f"""WITH {G}, p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM g WHERE src <> dst),
 dg AS (SELECT src AS x, count(*) AS k FROM nb GROUP BY 1),
 t AS (SELECT p.u, p.v, count(*) AS t FROM p JOIN nb a ON a.src = p.u JOIN nb b ON b.src = p.v AND b.dst = a.dst GROUP BY 1, 2),
 s AS (SELECT p.u, p.v, a.k AS du, b.k AS dv, coalesce(t.t, 0) AS t, max(coalesce(t.t, 0)) OVER () AS mu FROM p JOIN dg a ON a.x = p.u JOIN dg b ON b.x = p.v LEFT JOIN t ON t.u = p.u AND t.v = p.v)
 SELECT src, dst, count(*) AS k, round(max(coalesce(%s, 0)), 9) AS strength FROM g LEFT JOIN s ON s.u = least(src, dst) AND s.v = greatest(src, dst) GROUP BY 1, 2"""


@query(_STRENGTH % "CASE WHEN du + dv - 2 - t > 0 THEN least(1.0, t / (du + dv - 2 - t)) ELSE 0 END")
def metric_edge_strength(spark, d):
    return A.edge_strength(users(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("k"), F.round(F.max("strength"), 9).alias("strength"))


@query(_STRENGTH % "CASE WHEN mu + greatest(du, dv) - 1 - t > 0 THEN least(1.0, t / (mu + greatest(du, dv) - 1 - t)) ELSE 0 END")
def metric_edge_strength_corrected(spark, d):
    return A.edge_strength(users(spark, d), "corrected").groupBy("src", "dst").agg(F.count("*").alias("k"), F.round(F.max("strength"), 9).alias("strength"))


@query("""WITH x AS (SELECT p_partkey AS col, p_size::DOUBLE AS x FROM part), m AS (SELECT l_suppkey AS row, l_partkey AS col, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
 SELECT row, round(sum(w * x), 4) AS y FROM m JOIN x USING (col) GROUP BY 1""")
def metric_spmv(spark, d):
    m = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("w"))
    x = _t(spark, d, "part").select(F.col("p_partkey").alias("col"), F.col("p_size").cast("double").alias("x"))
    return A.spmv(m, x).select("row", F.round("y", 4).alias("y"))


@query()
def metric_core_numbers(spark, d):
    return A.core_numbers(users(spark, d))


def _betweenness_sql(hops: int) -> str:
    """Brandes by levels from the first 500 nodes; hops: as many levels as the graph can have."""
    out = f"WITH {G}, m AS (SELECT src, dst, count(*)::DOUBLE AS m FROM adj GROUP BY 1, 2), c AS (SELECT count(*) AS n FROM n), l0 AS MATERIALIZED (SELECT idx AS s, idx, 1.0::DOUBLE AS g FROM n WHERE idx < 500), v0 AS (SELECT s, idx FROM l0)"
    for k in range(hops):
        out += f""", l{k + 1} AS MATERIALIZED (SELECT l.s, m.dst AS idx, sum(l.g * m.m) AS g FROM l{k} l JOIN m ON m.src = l.idx ANTI JOIN v{k} v ON v.s = l.s AND v.idx = m.dst GROUP BY 1, 2),
 v{k + 1} AS MATERIALIZED (SELECT * FROM v{k} UNION ALL SELECT s, idx FROM l{k + 1})"""
    out += f", d{hops} AS (SELECT s, idx, g, 0.0::DOUBLE AS d FROM l{hops})"
    for k in reversed(range(hops)):
        out += f""", d{k} AS MATERIALIZED (SELECT l.s, l.idx, l.g, coalesce(sum(l.g * m.m * (1 + w.d) / w.g), 0) AS d FROM l{k} l LEFT JOIN (m JOIN d{k + 1} w ON w.idx = m.dst) ON m.src = l.idx AND w.s = l.s GROUP BY 1, 2, 3)"""
    every = " UNION ALL ".join(f"SELECT s, idx, d FROM d{k}" for k in range(hops + 1))
    return out + f""", t AS (SELECT idx, sum(d) AS d FROM ({every}) WHERE s <> idx GROUP BY 1)
 SELECT n.idx, round(coalesce(t.d, 0) * (CASE WHEN c.n > 2 THEN 1.0 / ((c.n - 1) * (c.n - 2)) ELSE 1 END) * (c.n::DOUBLE / greatest(1, least(500, c.n))), 9) AS betweenness FROM n CROSS JOIN c LEFT JOIN t USING (idx)"""


@query(_betweenness_sql(8))
def metric_betweenness(spark, d):
    return A.betweenness(users(spark, d)).select("idx", F.round("betweenness", 9).alias("betweenness"))


@query()
def metric_kcore_sweep(spark, d):
    return A.kcore_sweep(users(spark, d))


@query()
def metric_louvain(spark, d):
    return A.louvain(users(spark, d))


def _labels_sql(passes: int) -> str:
    out = f"WITH {G}, p0 AS (SELECT idx, idx AS label FROM n)"
    for k in range(passes):
        out += f""", p{k + 1} AS MATERIALIZED (SELECT p.idx, coalesce(b.label, p.label) AS label FROM p{k} p LEFT JOIN (SELECT src, label FROM (SELECT a.src, q.label, row_number() OVER (PARTITION BY a.src ORDER BY count(*) DESC, q.label) AS r FROM adj a JOIN p{k} q ON q.idx = a.dst GROUP BY 1, 2) WHERE r = 1) b ON b.src = p.idx)"""
    return out + f" SELECT idx, dense_rank() OVER (ORDER BY f) - 1 AS label FROM (SELECT idx, min(idx) OVER (PARTITION BY label) AS f FROM p{passes})"


@query(_labels_sql(10))
def metric_label_propagation(spark, d):
    return A.label_propagation(users(spark, d))


@query("""SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS nodes FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', trim(o_orderpriority), count(*) FROM orders GROUP BY 2""")
def facet_counts(spark, d):
    return filters.facet_catalog(filters.facet_members(_t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey"))


def _orders_filter() -> filters.Filter:
    R, Gp = filters.Rule, filters.Group
    tree = Gp("all", (Gp("any", (R("o_orderstatus", "eq", "O"), R("o_orderpriority", "contains", "urgent"))), R("o_orderpriority", "neq", "5-LOW"), R("o_orderpriority", "matches", "^[1-3]"), R("unknown", "eq", "x", enabled=False)))
    return filters.Filter(tree, ("o_orderstatus", "o_orderpriority"))


_KEPT = "(o_orderstatus = 'O' OR contains(lower(o_orderpriority), 'urgent')) AND o_orderpriority <> '5-LOW' AND regexp_matches(o_orderpriority, '^[1-3]')"


@query(f"SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE {_KEPT}")
def filter_tree(spark, d):
    return _orders_filter().apply(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query(f"""SELECT count_if({_KEPT}) AS root, count_if(o_orderstatus = 'O' OR contains(lower(o_orderpriority), 'urgent')) AS root_0, count_if(o_orderstatus = 'O') AS root_0_0,
 count_if(contains(lower(o_orderpriority), 'urgent')) AS root_0_1, count_if(o_orderpriority <> '5-LOW') AS root_1, count_if(regexp_matches(o_orderpriority, '^[1-3]')) AS root_2 FROM orders""")
def filter_tree_counts(spark, d):
    return _orders_filter().counts(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("""WITH t AS (SELECT p_partkey, replace(p_type, ' ', '/') AS tag FROM part), s AS (SELECT p_partkey, string_split(tag, '/') AS parts FROM t),
 b AS (SELECT p_partkey, array_to_string(parts[1:i], '/') AS branch FROM s, unnest(range(1, len(parts) + 1)) AS u(i)) SELECT branch, count(DISTINCT p_partkey) AS nodes FROM b GROUP BY 1""")
def tag_hierarchy(spark, d):
    tags = _t(spark, d, "part").select("p_partkey", F.regexp_replace("p_type", " ", "/").alias("tag"))
    return tags.select("p_partkey", F.explode(text.tag_branches(F.col("tag"))).alias("branch")).groupBy("branch").agg(F.countDistinct("p_partkey").alias("nodes"))


@query("""WITH w AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term <> ''),
 l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS a FROM l),
 p AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('the', 'of') GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
 SELECT doc_id AS idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 9) AS score
 FROM p JOIN f USING (term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY 1 HAVING count(*) = 2""")
def search_matches(spark, d):
    return search.score(documents_index(spark, d), "the of", {"text"}).select("idx", F.round("score", 9).alias("score"))


def documents_index(spark, d, stemming: bool = False) -> search.Index:
    """The index of documents, stored once for an application and state of the table."""

    def make() -> search.Index:
        docs = _t(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")
        return search.store(search.build(docs, {"text": 1.0}, stemming=stemming), fresh(spark, "index"))

    return kept(spark, f"index-{stemming}", f"{d}/documents.parquet", make)


@query("""SELECT o_orderkey, 'h256:' || left(sha256(o_orderpriority || o_orderkey), 32) AS content, 'c-' || left(sha256(o_orderstatus || chr(0) || o_orderkey || chr(0)), 16) AS change,
 trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM orders""")
def scalar_ids(spark, d):
    o = _t(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select("o_orderkey", text.content_id(F.concat("o_orderpriority", key)).alias("content"), text.part_id("c", F.col("o_orderstatus"), key).alias("change"), text.slug(F.col("o_orderpriority")).alias("slug"))


@query("""SELECT c_custkey, CASE WHEN k <= 0 THEN 0 ELSE floor(log2(k))::INT + 1 END AS bucket, round((k - min(k) OVER ()) / greatest(max(k) OVER () - min(k) OVER (), 1e-6), 9) AS level
 FROM (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def scalar_degree_buckets(spark, d):
    k = _t(spark, d, "customer").select("c_custkey").join(_t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k")), "c_custkey", "left").na.fill(0)
    return numeric.normalized(k, "k", "level").select("c_custkey", numeric.degree_bucket(F.col("k")).alias("bucket"), F.round("level", 9).alias("level"))


@query("""WITH s AS (SELECT c_custkey, floor(c_acctbal / 1000) AS score FROM customer), r AS (SELECT c_custkey, dense_rank() OVER (ORDER BY score DESC) - 1 AS ring, row_number() OVER (PARTITION BY score ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY score) AS n FROM s)
 SELECT c_custkey AS idx, ring::INT AS ring, round(cos(k * 2 * pi() / n) * ring * 50, 6) + 0.0 AS x, round(sin(k * 2 * pi() / n) * ring * 50, 6) + 0.0 AS y FROM r""")
def layout_concentric(spark, d):
    s = _t(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.floor(F.col("c_acctbal") / 1000).alias("score"))
    return layout.concentric(s).select("idx", "ring", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


_GRID = """z AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS cols FROM n), pt AS (SELECT idx, (idx % cols - (cols - 1) / 2::DOUBLE) * 10 AS x, (idx // cols - (greatest(1, ceil(n / cols)) - 1) / 2::DOUBLE) * 10 AS y FROM n, z)"""


@query(f"WITH {G}, {_GRID} SELECT idx, round(x, 6) AS x, round(y, 6) AS y, 0.0::DOUBLE AS z FROM pt")
def layout_grid(spark, d):
    g = users(spark, d)
    return layout.grid(g.nodes, g.nodes.count()).select("idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


def _bodies(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    body = lambda s, p: F.to_json(F.struct(F.col(p).alias("p") if isinstance(p, str) else p.alias("p"), F.col(s).alias("s") if isinstance(s, str) else s.alias("s")))
    base = o.select("id", body("o_orderstatus", "o_orderpriority").alias("body"))
    ours = o.filter("o_orderkey % 7 <> 3").select("id", body(F.when(F.col("o_orderkey") % 5 == 0, F.lit("A")).otherwise(F.col("o_orderstatus")), "o_orderpriority").alias("body"))
    theirs = o.filter("o_orderkey % 11 <> 4").select("id", body(F.when(F.col("o_orderkey") % 15 == 0, F.lit("B")).otherwise(F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 4 == 0, F.lit("new")).otherwise(F.col("o_orderpriority"))).alias("body"))
    return base, ours, theirs


@query("""SELECT 'delete_node' AS kind, o_orderkey::VARCHAR AS id, NULL::VARCHAR AS body FROM orders WHERE o_orderkey % 7 = 3
 UNION ALL SELECT 'upsert_node', o_orderkey::VARCHAR, '{"p":"' || o_orderpriority || '","s":"A"}' FROM orders WHERE o_orderkey % 7 <> 3 AND o_orderkey % 5 = 0 AND o_orderstatus <> 'A'""")
def version_diff(spark, d):
    base, ours, _ = _bodies(spark, d)
    return versions.diff_nodes(base, ours)


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 7 = 3 AS od, o_orderkey % 11 = 4 AS td, CASE WHEN o_orderkey % 5 = 0 THEN 'A' ELSE o_orderstatus END AS os,
   CASE WHEN o_orderkey % 15 = 0 THEN 'B' ELSE o_orderstatus END AS ts, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderpriority END AS tp FROM orders),
 m AS (SELECT *, CASE WHEN os = ts OR ts = s THEN os WHEN os = s THEN ts ELSE os END AS ms, NOT (os = ts OR ts = s OR os = s) AS c, CASE WHEN tp = p THEN p ELSE tp END AS mp FROM x)
 SELECT k::VARCHAR AS id, CASE WHEN od THEN NULL WHEN td THEN CASE WHEN os = s THEN NULL ELSE '{"p":"' || p || '","s":"' || os || '"}' END ELSE '{"p":"' || mp || '","s":"' || ms || '"}' END AS body,
  CASE WHEN od AND td THEN true WHEN od THEN ts = s AND tp = p WHEN td THEN os = s ELSE NOT c END AS clean FROM m""")
def version_merge(spark, d):
    return versions.merge_nodes(*_bodies(spark, d)).select("id", "body", "clean")


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), o AS (SELECT * FROM b WHERE src % 3 <> 0 UNION SELECT dst, src FROM b WHERE src % 10 = 1), t AS (SELECT * FROM b WHERE dst % 3 <> 0 UNION SELECT dst, src FROM b WHERE src % 10 = 2)
 SELECT src, dst FROM ((SELECT * FROM o INTERSECT SELECT * FROM t) UNION (SELECT * FROM o EXCEPT SELECT * FROM b) UNION (SELECT * FROM t EXCEPT SELECT * FROM b))""")
def version_merge_edges(spark, d):
    b = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    turned = lambda k: b.filter(F.col("src") % 10 == k).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return versions.merge_edges(b, b.filter("src % 3 <> 0").union(turned(1)).distinct(), b.filter("dst % 3 <> 0").union(turned(2)).distinct())


@query("""WITH k AS (SELECT c_nationkey AS branch, o_orderdate AS ts, o_orderkey::VARCHAR AS commit FROM orders JOIN customer ON c_custkey = o_custkey)
 SELECT branch, commit, place FROM (SELECT branch, commit, row_number() OVER (PARTITION BY branch ORDER BY ts DESC, commit DESC)::INT AS place FROM k) WHERE place <= 5""")
def version_log(spark, d):
    k = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("branch"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").cast("string").alias("commit"))
    return versions.last_commits(k, 5).select("branch", "commit", "place")


@query("""WITH e AS (SELECT event_type AS id, user_id, ts, event_id FROM events) SELECT id, arg_max(event_id, event_id) AS frame, count(*) AS frames FROM e GROUP BY 1""")
def stream_latest(spark, d):
    e = _t(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("id")).agg(F.max_by("event_id", "event_id").alias("frame"), F.count("*").alias("frames"))


def _spring_sql(steps: int) -> str:
    out = f"WITH {G}, c AS (SELECT count(*) AS n FROM n), s0 AS (SELECT idx, cos(idx * 2 * pi() / n) * (200 + 4 * sqrt(n)) AS x, sin(idx * 2 * pi() / n) * (200 + 4 * sqrt(n)) AS y, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM n, c)"
    for k in range(steps):
        out += f""", f{k} AS (SELECT a.idx, count(*) AS deg, sum(q.f * (b.x - a.x)) AS fx, sum(q.f * (b.y - a.y)) AS fy FROM adj e JOIN s{k} a ON a.idx = e.src JOIN s{k} b ON b.idx = e.dst, LATERAL (SELECT greatest(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 1e-9) AS d) r, LATERAL (SELECT 0.05 * (r.d - 30) / r.d AS f) q GROUP BY 1),
 v{k} AS (SELECT s.idx, s.x, s.y, (s.vx * 0.9 + 0.1 * coalesce(fx, 0)) / (1 + 0.1 * 0.05 * coalesce(deg, 0)) AS vx, (s.vy * 0.9 + 0.1 * coalesce(fy, 0)) / (1 + 0.1 * 0.05 * coalesce(deg, 0)) AS vy FROM s{k} s LEFT JOIN f{k} USING (idx)),
 s{k + 1} AS MATERIALIZED (SELECT idx, x + 0.1 * vx AS x, y + 0.1 * vy AS y, vx, vy FROM v{k})"""
    return out + f" SELECT idx, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM s{steps}"


@query(_spring_sql(5))
def layout_spring(spark, d):
    """Five steps of the spring engine."""
    pos = forces.engine("cpu-spring").init(users(spark, d)).run(5)
    return pos.select("idx", *((F.round(c, 6) + 0.0).alias(c) for c in "xy"))
