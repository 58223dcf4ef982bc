"""Registered queries of measures, forces, the version store, listings, importers and the query language of search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import analytics as A
from ..operators import forces, layout, listings, measures, partition, search, versions
from ..operators.store import Store, merged_graphs
from ..sources import importers
from .queries import G, _bodies, _t, documents_index, query, users
from .structure import H, hierarchy
from .tables import fresh, settle

_FRAMES = "l AS (SELECT l_orderkey AS idx, l_linenumber AS frame, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_tax) = 1)"


def _lines(spark, d) -> DataFrame:
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    rows = _t(spark, d, "lineitem").withColumn("r", F.row_number().over(one)).filter("r = 1")
    return rows.select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("frame"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))


@query(f"""WITH {_FRAMES}, m AS (SELECT frame, greatest(abs(x), abs(y), abs(z)) AS most, sqrt(x * x + y * y + z * z) AS r, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS mv FROM l WINDOW w AS (PARTITION BY idx ORDER BY frame)),
 k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY r) - 1 AS kr, row_number() OVER (PARTITION BY frame ORDER BY mv) - 1 AS km, count(*) OVER (PARTITION BY frame) AS n FROM m)
 SELECT frame, round(max(most), 6) AS most, round(avg(mv), 6) AS mean_move, 0::BIGINT AS not_finite, round(max(CASE WHEN kr = floor((n - 1) * 0.5) THEN r END), 6) AS p50_radius, round(max(CASE WHEN kr = floor((n - 1) * 0.99) THEN r END), 6) AS p99_radius, round(max(CASE WHEN km = floor((n - 1) * 0.5) THEN mv END), 6) AS p50_move FROM k GROUP BY 1""")
def measure_telemetry(spark, d):
    """Lines of orders as frames of points."""
    out = measures.telemetry(_lines(spark, d))
    return out.select("frame", "not_finite", *(F.round(c, 6).alias(c) for c in ("most", "mean_move", "p50_radius", "p99_radius", "p50_move")))


_TREE = f"""{H}, zz AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS cols FROM hn), xy AS (SELECT hn.*, CASE place WHEN 1 THEN key ELSE c.c_nationkey END AS nation, (idx % cols - (cols - 1) / 2::DOUBLE) * 10 AS x, (idx // cols - (greatest(1, ceil(n / cols)) - 1) / 2::DOUBLE) * 10 AS y FROM hn CROSS JOIN zz
  LEFT JOIN (SELECT 'tpch:main:customer/' || c_custkey AS id, c_nationkey FROM customer UNION ALL SELECT 'tpch:main:supplier/' || s_suppkey, s_nationkey FROM supplier) c ON c.id = hn.id)"""


@query(f"""WITH {_TREE}, e AS (SELECT row_number() OVER () AS k, a.idx AS s, b.idx AS t, a.x AS x, a.y AS y, b.x AS x2, b.y AS y2 FROM xy a JOIN xy b ON b.id = a.up), l AS (SELECT sqrt((x - x2) ** 2 + (y - y2) ** 2) AS len FROM e),
 c AS (SELECT count(*) AS crossings FROM e a JOIN e b ON a.k < b.k AND a.s <> b.s AND a.s <> b.t AND a.t <> b.s AND a.t <> b.t
  AND sign((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x)) * sign((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x)) < 0
  AND sign((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x)) * sign((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x)) < 0),
 p AS (SELECT CASE WHEN a.place = 0 THEN least(b.place, 2) WHEN a.place = 1 AND b.place = 1 THEN 2 WHEN a.place = 1 THEN CASE WHEN a.nation = b.nation THEN 1 ELSE 3 END WHEN a.nation = b.nation THEN 2 ELSE 4 END AS d, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS w FROM xy a JOIN xy b ON a.root = b.root AND a.idx < b.idx),
 q AS (SELECT count(*) AS pairs, sum(w / d) AS cr, sum((w / d) ** 2) AS o FROM p)
 SELECT round(stddev_pop(len) / avg(len), 6) AS cv, max(crossings) AS crossings, max(pairs) AS pairs, round(max((pairs - cr * cr / o) / pairs), 6) AS stress FROM l, c, q""")
def layout_quality(spark, d):
    """The hierarchy of the tables laid out as a grid."""
    g = hierarchy(spark, d)
    g = Graph(g.nodes, settle(g.edges, "edges"))
    pos = settle(layout.grid(g.nodes, g.nodes.count()), "grid")
    quality = layout.length_variation(g, pos).select(F.round("cv", 6).alias("cv")).crossJoin(layout.crossings(g, pos, 40.0, 10.0))  # one row each
    return quality.crossJoin(measures.all_pairs_stress(g, pos, 10.0).select("pairs", F.round("stress", 6).alias("stress")))


@query(f"""WITH {_FRAMES}, u AS (SELECT (x - 25) / r AS x, (y - 5) / r AS y, (z - 4) / r AS z FROM (SELECT *, sqrt((x - 25) ** 2 + (y - 5) ** 2 + (z - 4) ** 2) AS r FROM l) WHERE r > 0),
 q AS (SELECT avg(x * x) - 1 / 3::DOUBLE AS xx, avg(y * y) - 1 / 3::DOUBLE AS yy, avg(z * z) - 1 / 3::DOUBLE AS zz, avg(x * y) AS xy, avg(x * z) AS xz, avg(y * z) AS yz FROM u),
 p AS (SELECT *, sqrt((xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
 e AS (SELECT p, (xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) / p ** 3 AS det FROM p)
 SELECT round(1.5 * 2 * p * cos(acos(greatest(-1, least(1, det / 2))) / 3), 6) AS nematic FROM e""")
def measure_nematic(spark, d):
    p = _lines(spark, d).select((F.col("x") - 25).alias("x"), (F.col("y") - 5).alias("y"), (F.col("z") - 4).alias("z"))
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return measures.nematic_order(p.filter(r > 0).select(*((F.col(c) / r).alias(c) for c in "xyz"))).select(F.round("nematic", 6).alias("nematic"))


@query("SELECT count(*) AS clusters, max(n) AS largest, round(max(n) / sum(n), 9) AS share FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)")
def measure_clusters(spark, d):
    """Customers in contact with the next one of their nation."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("idx"), "c_nationkey")
    touching = c.select("idx", F.lead("idx").over(Window.partitionBy("c_nationkey").orderBy("idx")).alias("idx2")).filter("idx2 is not null")
    return measures.cluster_sizes(measures.clusters(c, touching)).select("clusters", "largest", F.round("share", 9).alias("share"))


@query("""WITH p AS (SELECT c_acctbal / 1000 AS x, (c_custkey % 13)::DOUBLE AS y, c_nationkey / 3::DOUBLE AS z FROM customer), c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p), r AS (SELECT x - cx AS x, y - cy AS y, z - cz AS z FROM p, c),
 s AS (SELECT sqrt(avg(x * x + y * y + z * z)) AS gyration FROM r), k AS (SELECT DISTINCT least(floor(acos(greatest(-1, least(1, z / sqrt(x * x + y * y + z * z)))) / pi() * 6), 5) AS b, least(floor((atan2(y, x) + pi()) / (2 * pi()) * 12), 11) AS t FROM r WHERE sqrt(x * x + y * y + z * z) > 1e-9),
 w AS (SELECT sum((cos(b * pi() / 6) - cos((b + 1) * pi() / 6)) / 24) AS closure FROM k) SELECT round(cx, 6) AS cx, round(gyration, 6) AS gyration, round(closure, 6) AS closure, closure >= 0.85 AS closed FROM c, s, w""")
def measure_closure(spark, d):
    p = _t(spark, d, "customer").select((F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 13).cast("double").alias("y"), (F.col("c_nationkey") / 3).alias("z"))
    return measures.closure(p).select(*(F.round(c, 6).alias(c) for c in ("cx", "gyration", "closure")), "closed")


_MOVING = "m AS (SELECT idx, (idx % 17)::DOUBLE AS x, (idx % 11)::DOUBLE AS y, (idx % 5)::DOUBLE AS z, (idx % 3)::DOUBLE AS vx, (idx % 2)::DOUBLE AS vy, 0.5::DOUBLE AS vz, 0.4 + (idx % 4) / 10::DOUBLE AS r FROM n)"


def _moving(g) -> DataFrame:
    k = lambda m: (F.col("idx") % m).cast("double")
    return g.nodes.select("idx", k(17).alias("x"), k(11).alias("y"), k(5).alias("z"), k(3).alias("vx"), k(2).alias("vy"), F.lit(0.5).alias("vz"), (0.4 + k(4) / 10).alias("r"))


@query(f"""WITH {G}, {_MOVING}, s AS (SELECT sum(0.5 * 0.05 * (sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) - 1) ** 2) AS springs FROM g JOIN m a ON a.idx = src JOIN m b ON b.idx = dst),
 k AS (SELECT sum(0.5 * 0.01 * (x * x + y * y + z * z)) AS gravity, sum(0.5 * (vx * vx + vy * vy + vz * vz)) AS kinetic FROM m),
 t AS (SELECT a.r + b.r AS rr, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS w FROM m a JOIN m b ON a.idx < b.idx), x AS (SELECT coalesce(sum(0.5 * (rr - w) ** 2), 0) AS exclusion FROM t WHERE w <= rr)
 SELECT round(springs, 4) AS springs, round(gravity, 4) AS gravity, round(kinetic, 4) AS kinetic, round(exclusion, 4) AS exclusion, round(springs + gravity + exclusion, 4) AS total FROM s, k, x""")
def measure_energies(spark, d):
    g = users(spark, d)
    p = _moving(g)
    return measures.energies(g.edges, p, layout.contacts(p, 1.0, 1.5)).select(*(F.round(c, 4).alias(c) for c in ("springs", "gravity", "kinetic", "exclusion", "total")))


@query(f"""WITH {G}, {_MOVING}, dg AS (SELECT n.idx, count(a.dst) AS k FROM n LEFT JOIN adj a ON a.src = n.idx GROUP BY 1)
 SELECT round(sum((k + 1) * sqrt((vx - x) ** 2 + (vy - y) ** 2 + (vz - z) ** 2)), 4) AS swinging, round(sum((k + 1) * 0.5 * sqrt((vx + x) ** 2 + (vy + y) ** 2 + (vz + z) ** 2)), 4) AS traction FROM m JOIN dg USING (idx)""")
def measure_swing(spark, d):
    g = users(spark, d)
    p = _moving(g)
    deg = g.nodes.select("idx").join(g.adjacency().groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("degree")), "idx", "left").na.fill(0)
    now, old = (p.select("idx", *(F.col(v + c).alias("f" + c) for c in "xyz")) for v in ("", "v"))
    return measures.swing(now, old, deg).select(F.round("swinging", 4).alias("swinging"), F.round("traction", 4).alias("traction"))


_CIRCLE = "cc AS (SELECT count(*) AS n FROM n), s0 AS (SELECT idx, cos(idx * 2 * pi() / n) * (200 + 4 * sqrt(n)) AS x, sin(idx * 2 * pi() / n) * (200 + 4 * sqrt(n)) AS y FROM n, cc)"


@query(f"""WITH {G}, {_CIRCLE}, dg AS (SELECT n.idx, count(a.dst) + 1 AS k FROM n LEFT JOIN adj a ON a.src = n.idx GROUP BY 1),
 p AS (SELECT * FROM s0 JOIN dg USING (idx)),
 r AS (SELECT a.idx, sum(2.0 * a.k * b.k * (a.x - b.x) / greatest((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 1e-4)) AS fx, sum(2.0 * a.k * b.k * (a.y - b.y) / greatest((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 1e-4)) AS fy FROM p a JOIN p b ON a.idx <> b.idx GROUP BY 1),
 t AS (SELECT e.src AS idx, sum(b.x - a.x) AS fx, sum(b.y - a.y) AS fy FROM adj e JOIN p a ON a.idx = e.src JOIN p b ON b.idx = e.dst GROUP BY 1)
 SELECT p.idx, round(coalesce(r.fx, 0) + coalesce(t.fx, 0) - p.x * p.k / sqrt(p.x ** 2 + p.y ** 2), 4) + 0.0 AS fx, round(coalesce(r.fy, 0) + coalesce(t.fy, 0) - p.y * p.k / sqrt(p.x ** 2 + p.y ** 2), 4) + 0.0 AS fy FROM p LEFT JOIN r USING (idx) LEFT JOIN t USING (idx)""")
def layout_fa2_forces(spark, d):
    """All forces of the first step, exact."""
    force = forces.engine("fa2-brute").init(users(spark, d)).forces()
    return force.select("idx", *((F.round("f" + c, 4) + 0.0).alias("f" + c) for c in "xy"))


@query()
def layout_fa2_barnes_hut(spark, d):
    return forces.engine("fa2-bh").init(users(spark, d)).run(3)


@query(f"""WITH {G}, {_CIRCLE}, kk AS (SELECT 100 / sqrt(n) AS k FROM cc),
 r AS (SELECT a.idx, sum(k * k * (a.x - b.x) / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + 1e-4)) AS fx, sum(k * k * (a.y - b.y) / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + 1e-4)) AS fy FROM s0 a JOIN s0 b ON a.idx <> b.idx, kk GROUP BY 1),
 t AS (SELECT e.src AS idx, sum((b.x - a.x) * sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + 1e-4) / k) AS fx, sum((b.y - a.y) * sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + 1e-4) / k) AS fy FROM adj e JOIN s0 a ON a.idx = e.src JOIN s0 b ON b.idx = e.dst, kk GROUP BY 1),
 f AS (SELECT s0.idx, x, y, k, coalesce(r.fx, 0) + coalesce(t.fx, 0) AS fx, coalesce(r.fy, 0) + coalesce(t.fy, 0) AS fy FROM s0 LEFT JOIN r USING (idx) LEFT JOIN t USING (idx), kk)
 SELECT idx, round(x + fx * least(sqrt(fx ** 2 + fy ** 2 + 1e-12), 0.1 * k) / sqrt(fx ** 2 + fy ** 2 + 1e-12), 6) + 0.0 AS x, round(y + fy * least(sqrt(fx ** 2 + fy ** 2 + 1e-12), 0.1 * k) / sqrt(fx ** 2 + fy ** 2 + 1e-12), 6) + 0.0 AS y FROM f""")
def layout_fruchterman_reingold(spark, d):
    """One step, exact."""
    pos = forces.engine("fruchterman-reingold", theta=0.0).init(users(spark, d)).run(1)
    return pos.select("idx", *((F.round(c, 6) + 0.0).alias(c) for c in "xy"))


@query()
def layout_sgd_stress(spark, d):
    return forces.engine("sgd-stress", rounds=10).init(users(spark, d)).run(10)


@query()
def layout_multilevel(spark, d):
    return forces.engine("multilevel", inner="fruchterman-reingold", sweeps=2).init(users(spark, d)).run(1)


@query()
def partition_refined(spark, d):
    g = users(spark, d)
    return partition.refined(g, partition.regions(g, 4), 4)


@query()
def partition_first_touch(spark, d):
    return partition.first_touch(users(spark, d))


@query()
def partition_cascade(spark, d):
    """Nodes and links of each level."""
    out = None
    for k, (g, _) in enumerate(partition.cascade(users(spark, d))):
        row = g.nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(g.edges.agg(F.count("*").alias("edges")))).withColumn("level", F.lit(k))
        out = row if out is None else out.unionAll(row)
    return out


def _store(spark, d) -> Store:
    """main: all orders, then ours' changes; side: theirs' changes, from the first commit."""
    base, ours, theirs = _bodies(spark, d)
    store = Store(spark, fresh(spark, "store"))
    none, edges = spark.createDataFrame([], "id string, body string"), _t(spark, d, "orders").select(F.lit("upsert_edge").alias("kind"), F.col("o_orderkey").cast("string").alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    ops = lambda a, b: versions.diff_nodes(a, b).withColumn("seq", F.lit(1))
    first = store.commit("main", ops(none, base), edges.withColumn("seq", F.lit(1)), "first", 1)
    store.create_branch("side", first)
    store.commit("main", ops(base, ours), None, "ours", 2)
    store.commit("side", ops(base, theirs), None, "theirs", 3)
    return store


_MERGED = """x AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 7 = 3 AS od, o_orderkey % 11 = 4 AS td, CASE WHEN o_orderkey % 5 = 0 THEN 'A' ELSE o_orderstatus END AS os,
   CASE WHEN o_orderkey % 15 = 0 THEN 'B' ELSE o_orderstatus END AS ts, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderpriority END AS tp FROM orders),
 m AS (SELECT *, CASE WHEN os = ts OR ts = s THEN os WHEN os = s THEN ts ELSE os END AS ms, CASE WHEN tp = p THEN p ELSE tp END AS mp FROM x),
 r AS (SELECT k::VARCHAR AS id, CASE WHEN od THEN NULL WHEN td THEN CASE WHEN os = s THEN NULL ELSE '{"p":"' || p || '","s":"' || os || '"}' END ELSE '{"p":"' || mp || '","s":"' || ms || '"}' END AS body FROM m)"""


@query(f"WITH {_MERGED} SELECT id, body FROM r WHERE body IS NOT NULL")
def version_store_merge(spark, d):
    store = _store(spark, d)
    return store.snapshot(store.merge("main", "side", ts=4)[1])[0]


@query("SELECT 0 AS place, 'merge' AS message, 4::BIGINT AS ts UNION ALL SELECT 1, 'ours', 2 UNION ALL SELECT 2, 'first', 1")
def version_store_log(spark, d):
    store = _store(spark, d)
    store.merge("main", "side", ts=4)
    return store.log("main").select("place", "message", "ts")


@query(f"WITH {_MERGED} SELECT id, body FROM r WHERE body IS NOT NULL")
def version_store_rebase(spark, d):
    """theirs' changes replayed on ours': the merge with ours first."""
    store = _store(spark, d)
    return store.snapshot(store.rebase("side", "main"))[0]


@query("SELECT 'world:orders:' || o_orderkey AS id, o_orderkey::VARCHAR AS title, 'note' AS kind, 'world:orders:c' || o_custkey AS lost FROM orders WHERE o_orderkey % 7 <> 3")
def source_world(spark, d):
    """The head of main as a source: orders, and the customers that their edges miss."""
    nodes, _, _, loose = _store(spark, d).world("Orders!")
    return nodes.join(loose.select(F.col("src").alias("id"), F.col("dst").alias("lost")), "id").select("id", "title", "kind", "lost")


@query("""SELECT coalesce(b.k, a.k)::VARCHAR AS id, coalesce(b.body, a.body) AS body FROM (SELECT c_custkey AS k, c_mktsegment AS body FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_name AS body FROM supplier) b ON a.k = b.k""")
def graph_merged(spark, d):
    side = lambda t, k, b: (_t(spark, d, t).select(F.col(k).cast("string").alias("id"), F.col(b).alias("body")), spark.createDataFrame([], "src string, dst string"))
    return merged_graphs(side("customer", "c_custkey", "c_mktsegment"), side("supplier", "s_suppkey", "s_name"))[0]


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT src, dst FROM b WHERE dst % 3 <> 0 UNION SELECT dst, src FROM b WHERE src % 10 = 1""")
def version_apply_edges(spark, d):
    b = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    gone = b.filter("dst % 3 = 0").select(F.lit(1).alias("seq"), F.lit("delete_edge").alias("kind"), "src", "dst")
    come = b.filter("src % 10 = 1").select(F.lit(2).alias("seq"), F.lit("upsert_edge").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return versions.apply_edges(b, gone.unionAll(come))


@query("SELECT tag, nodes FROM (SELECT p_brand || '/' || p_size AS tag, count(*) AS nodes FROM part GROUP BY 1) ORDER BY nodes DESC, tag LIMIT 80")
def listing_top_tags(spark, d):
    """The 80 commonest: the limit is the feature."""
    return listings.top_tags(_t(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("tag")))


@query(f"WITH {G}, k AS (SELECT src AS idx, count(*) AS c FROM nb GROUP BY 1) SELECT n.idx, least(coalesce(c, 0), 10) AS shown, greatest(coalesce(c, 0) - 10, 0) AS left_out FROM n LEFT JOIN k USING (idx)")
def listing_pills(spark, d):
    return listings.all_neighbour_counts(users(spark, d), 10)


@query(f"WITH {H} SELECT idx, dense_rank() OVER (ORDER BY f) - 1 AS community, members FROM (SELECT idx, min(idx) OVER (PARTITION BY root) AS f, count(*) OVER (PARTITION BY root) AS members FROM hn)")
def listing_communities(spark, d):
    return listings.community_sizes(A.wcc(hierarchy(spark, d)).withColumnRenamed("wcc", "community"))


@query(f"WITH {H}, m AS (SELECT * FROM hn WHERE root = (SELECT root FROM hn WHERE idx = 7)) SELECT idx FROM m")
def listing_community_members(spark, d):
    return listings.community_members(A.wcc(hierarchy(spark, d)).withColumnRenamed("wcc", "community"), 7)


@query("SELECT page_id, regexp_matches(lower(p), '\\.(md|markdown)$') AND NOT regexp_matches(p, '(^|/)\\.[^/]') AS relevant FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/.b/x.md' WHEN 1 THEN url || '.MD' ELSE url END AS p FROM pages)")
def scalar_relevant_paths(spark, d):
    path = F.when(F.col("page_id") % 3 == 0, "a/.b/x.md").when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(".MD"))).otherwise(F.col("url"))
    return _t(spark, d, "pages").select("page_id", listings.relevant_path(path).alias("relevant"))


@query("""SELECT o_orderkey, 'by ' || o_orderstatus AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'open' END AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'O,P' ELSE 'O,' || o_orderstatus || ',P' END AS authors, 'Order ' || o_custkey AS related, 'orders' AS folder,
 'h256:' || left(sha256('Body of ' || o_orderkey), 32) AS content_hash FROM orders""")
def source_discovery(spark, d):
    """Orders as notes with frontmatter."""
    key, s = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    block = F.concat(
        F.lit("---\ndescription: by "), s, F.lit("\nstatus: "), F.when(F.col("o_orderkey") % 2 == 0, "open").otherwise(" "),
        F.lit("\nauthors: O, "), s, F.lit(", P , O\nrelated:\n- [[Order "), F.col("o_custkey").cast("string"), F.lit("|the order]]\n---\nBody of "), key,
    )
    notes = importers.split_frontmatter(_t(spark, d, "orders").select(F.concat(F.lit("orders/"), key, F.lit(".md")).alias("path"), block.alias("text")))
    found = importers.discovery(notes)
    number = F.regexp_extract("path", r"(\d+)\.md", 1).cast("long")
    return found.select(number.alias("o_orderkey"), "description", "status", F.array_join("authors", ",").alias("authors"), F.array_join("related", ",").alias("related"), "folder", "content_hash")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'unverified' WHEN 1 THEN 'human-reviewed' ELSE 'machine-confirmed' END AS trust, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'human:' || c_name || ',tool' ELSE 'tool' END AS verified,
 c_mktsegment AS titles FROM customer""")
def source_trust(spark, d):
    c = _t(spark, d, "customer")
    entry = lambda by: F.struct(by.alias("by"))
    k = F.col("c_custkey") % 4
    tool, human = F.to_json(F.array(entry(F.lit("tool")), entry(F.lit("tool")), entry(F.lit(" ")))), F.to_json(F.array(entry(F.lit("tool")), entry(F.concat(F.lit("human:"), "c_name"))))
    one = F.to_json(entry(F.lit("tool")))
    verified = F.when(k == 0, "null").when(k == 1, human).when(k == 2, tool).otherwise(one)
    sources = F.to_json(F.array(F.struct(F.col("c_mktsegment").alias("title"), F.lit(None).cast("string").alias("author")), F.struct(F.col("c_mktsegment").alias("title"), F.lit("").alias("author"))))
    rows = c.select("c_custkey", F.concat(F.lit('{"verified":'), verified, F.lit(',"sources":'), sources, F.lit("}")).alias("props"))
    out = importers.concept_discovery(rows)
    return out.select("c_custkey", "trust", F.array_join("verified", ",").alias("verified"), F.array_join("source_titles", ",").alias("titles"))


@query("SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS titles FROM orders")
def scalar_path_strings(spark, d):
    o = _t(spark, d, "orders")
    item = lambda c: F.struct(F.col(c).alias("title"), F.col("o_orderkey").alias("n"))
    rows = o.select("o_orderkey", F.to_json(F.struct(F.array(item("o_orderstatus"), item("o_orderpriority")).alias("sources"))).alias("j"))
    return rows.select("o_orderkey", F.array_join(importers.path_strings("j", "sources[*].title"), "|").alias("titles"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def scalar_json_text(spark, d):
    return _t(spark, d, "events").select("event_id", importers.json_text("props", "/k").alias("k"))


_WORDS = "w AS (SELECT doc_id, i AS at, l[i] AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"


@query(f"WITH {_WORDS} SELECT DISTINCT a.doc_id AS idx FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.at = a.at + 1 WHERE a.term = 'of' AND b.term = 'the'")
def search_phrase(spark, d):
    return search.score(documents_index(spark, d), '"of the"', {"text"}).select("idx")


@query(f"WITH {_WORDS}, s AS (SELECT doc_id, bool_or(term = 'the') AS a, bool_or(term = 'der') AS b, bool_or(term = 'of') AS c FROM w GROUP BY 1) SELECT doc_id AS idx FROM s WHERE (a OR b) AND NOT c")
def search_boolean(spark, d):
    return search.score(documents_index(spark, d), "the OR der NOT of", {"text"}).select("idx")


@query(f"WITH {_WORDS} SELECT count(DISTINCT doc_id) AS total, least(50, count(DISTINCT doc_id)) AS shown FROM w WHERE term = 'der'")
def search_total(spark, d):
    top = search.rank_with_total(documents_index(spark, d), "der", {"text"})
    return top.agg(F.max("total").alias("total"), F.count("*").alias("shown"))


@query()
def search_stemmed(spark, d):
    """The 50 best for a word in any of its forms: the limit is the feature."""
    return search.rank(documents_index(spark, d, True), "the with", {"text"}).select("idx", F.round("score", 9).alias("score"))
