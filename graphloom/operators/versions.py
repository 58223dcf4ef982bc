"""Snapshots of a graph: diff, apply, three-way merge, and walks over the commit graph."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions.text import canonical
from ..plans.tables import settle


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """ops(kind, id, body) that turn nodes(id, body) old into new."""
    a, b = old.select("id", F.col("body").alias("a")), new.select("id", F.col("body").alias("b"))
    both = a.join(b, "id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(F.when(F.col("b").isNull(), "delete_node").otherwise("upsert_node").alias("kind"), "id", F.col("b").alias("body"))


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """ops(kind, src, dst); edges are sets."""
    gone = old.join(new, ["src", "dst"], "left_anti").distinct().select(F.lit("delete_edge").alias("kind"), "src", "dst")
    come = new.join(old, ["src", "dst"], "left_anti").distinct().select(F.lit("upsert_edge").alias("kind"), "src", "dst")
    return come.unionAll(gone)


def apply_nodes(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """Nodes after ops(seq, kind, id, body); the last op on an id wins. Edges of deleted nodes stay."""
    last = ops.groupBy("id").agg(F.max_by(F.struct("kind", "body"), "seq").alias("op"))
    kept = nodes.select("id", "body").join(last, "id", "left_anti")
    return kept.unionByName(last.filter("op.kind = 'upsert_node'").select("id", "op.body"))


def apply_edges(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """Edges after ops(seq, kind, src, dst), a set; the last op on a pair wins."""
    last = ops.groupBy("src", "dst").agg(F.max_by("kind", "seq").alias("kind"))
    return edges.select("src", "dst").join(last, ["src", "dst"], "left_anti").unionByName(last.filter("kind = 'upsert_edge'").select("src", "dst")).distinct()


def merge_edges(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(ours and theirs) or (ours without base) or (theirs without base), by one count of where each edge is."""
    tag = lambda df, b, o, t: df.select("src", "dst", F.lit(b).alias("b"), F.lit(o).alias("o"), F.lit(t).alias("t"))
    where = tag(base, 1, 0, 0).unionAll(tag(ours, 0, 1, 0)).unionAll(tag(theirs, 0, 0, 1)).groupBy("src", "dst").agg(F.max("b").alias("b"), F.max("o").alias("o"), F.max("t").alias("t"))
    return where.filter("(o = 1 and t = 1) or (b = 0 and (o = 1 or t = 1))").select("src", "dst")


def merge_value(base, ours, theirs):
    """(merged, clean): key by key in objects; a side that did not change yields; else ours with a conflict."""
    if ours == theirs or theirs == base:
        return ours, True
    if ours == base:
        return theirs, True
    if isinstance(ours, dict) and isinstance(theirs, dict):
        was, gone = base if isinstance(base, dict) else {}, object()
        out, clean = {}, True
        for k in {**ours, **theirs}:
            v, ok = merge_value(was.get(k, gone), ours.get(k, gone), theirs.get(k, gone))
            clean = clean and ok
            if v is not gone:
                out[k] = v
        return out, clean
    return ours, False


@pandas_udf(StructType([StructField("body", StringType()), StructField("clean", BooleanType())]))
def _merge_bodies(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
    rows = []
    for b, o, t in zip(base, ours, theirs, strict=True):
        v, ok = merge_value(*(None if x is None else json.loads(x) for x in (b, o, t)))
        rows.append((None if v is None else canonical(v), ok))
    return pd.DataFrame(rows, columns=["body", "clean"])


def merge_nodes(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """id, body, clean, base, ours, theirs; a null body is a node that stays deleted. Only bodies that both sides changed leave the JVM."""
    side = lambda df, name: df.select("id", F.col("body").alias(name))
    all_ = side(base, "base").join(side(ours, "ours"), "id", "full_outer").join(side(theirs, "theirs"), "id", "full_outer")
    b, o, t = (F.col(c) for c in ("base", "ours", "theirs"))
    kept = o.eqNullSafe(t) | t.eqNullSafe(b)
    plain = kept | o.eqNullSafe(b)
    easy = all_.filter(plain).select("id", F.when(kept, o).otherwise(t).alias("body"), F.lit(True).alias("clean"), "base", "ours", "theirs")
    hard = all_.filter(~plain).withColumn("m", _merge_bodies("base", "ours", "theirs")).select("id", "m.body", "m.clean", "base", "ours", "theirs")
    return easy.unionByName(hard)


def ancestors(parents: DataFrame, start: str) -> DataFrame:
    """commit, depth: the least number of steps from start over parents(commit, parent)."""
    spark = parents.sparkSession
    seen = spark.createDataFrame([(start, 0)], "commit string, depth int")
    front, depth = seen, 0
    while front.limit(1).count():
        depth += 1
        front = settle(front.join(parents, "commit").select(F.col("parent").alias("commit")).distinct().join(seen, "commit", "left_anti").withColumn("depth", F.lit(depth)), "front")
        seen = seen.unionAll(front)
    return seen


def common_ancestor(parents: DataFrame, a: str, b: str) -> DataFrame:
    """One row at most: the nearest common ancestor, by depth from a, then from b, then name."""
    x, y = ancestors(parents, a), ancestors(parents, b).withColumnRenamed("depth", "depth_b")
    return x.join(y, "commit").orderBy("depth", "depth_b", "commit").limit(1)


def replayed(parents: DataFrame, branch: str, onto: str) -> DataFrame:
    """Commits of the branch that are not on the other side, parents first."""
    return ancestors(parents, branch).join(ancestors(parents, onto), "commit", "left_anti").orderBy(F.desc("depth"), "commit")


def op_log(ops: DataFrame, limit: int) -> DataFrame:
    return ops.orderBy(F.desc("seq")).limit(limit)


def last_commits(log: DataFrame, k: int) -> DataFrame:
    """The newest k commits of each branch of log(branch, ts, commit)."""
    newest = Window.partitionBy("branch").orderBy(F.desc("ts"), F.desc("commit"))
    return log.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= k)


def resolve(merged: DataFrame, choices: DataFrame) -> DataFrame:
    """Merged nodes after choices(id, choice, body): ours, theirs, deleted or an explicit body; the others stay as they are."""
    c = F.col("choice")
    body = F.when(c == "ours", F.col("ours")).when(c == "theirs", F.col("theirs")).when(c == "explicit", F.col("chosen")).when(c == "deleted", F.lit(None)).otherwise(F.col("body"))
    out = merged.join(choices.select("id", "choice", F.col("body").alias("chosen")), "id", "left")
    return out.select("id", body.alias("body"), (F.col("clean") | c.isNotNull()).alias("clean"), "base", "ours", "theirs")


def first_parent_log(parents: DataFrame, start: str, limit: int) -> DataFrame:
    """commit, place of the walk from start along first parents of parents(commit, parent, nth), newest first.

    Walks by doubling: after k rounds a table of jumps of 2 ** k steps gives as many commits at once.
    """
    spark = parents.sparkSession
    jump = settle(parents.filter("nth = 0").select("commit", F.col("parent").alias("to")), "jump")
    seen = settle(spark.createDataFrame([(start, 0)], "commit string, place int"), "log")
    step = 1
    while step < limit:
        more = seen.join(jump, "commit").select(F.col("to").alias("commit"), (F.col("place") + step).alias("place"))
        if not more.limit(1).count():
            break
        seen = settle(seen.unionAll(more), "log")
        jump = settle(jump.select("commit", F.col("to").alias("via")).join(jump.select(F.col("commit").alias("via"), "to"), "via").select("commit", "to"), "jump")
        step *= 2
    return seen.filter(F.col("place") < limit)


def topological(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """commit, level: the longest way from a root, so that ordering by (level, commit) puts parents first; a cycle is refused."""
    links = settle(parents.select("commit", "parent").distinct(), "links")
    roots = commits.select("commit").join(links, "commit", "left_anti")
    done = settle(roots.withColumn("level", F.lit(0)), "levels")
    left, level = settle(commits.select("commit").join(done, "commit", "left_anti"), "left"), 0
    while left.limit(1).count():
        level += 1
        waits = links.join(left.select(F.col("commit").alias("parent")), "parent", "left_semi").select("commit")
        ready = settle(left.join(waits, "commit", "left_anti").withColumn("level", F.lit(level)), "ready")
        if not ready.limit(1).count():
            raise ValueError("commits form a cycle")
        done, left = done.unionAll(ready), settle(left.join(ready, "commit", "left_anti"), "left")
    return done


def ordered_ops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All ops of a diff with their place: node upserts, node deletes, edge upserts, edge deletes."""
    place = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(("upsert_node", "delete_node", "upsert_edge", "delete_edge")) for x in (k, i))), F.col("kind"))
    return nodes.unionByName(edges, allowMissingColumns=True).withColumn("place", place)


def merge_kind(parents: DataFrame, ours: str, theirs: str) -> tuple[str, str | None]:
    """What a merge of theirs into ours takes, and the base: up-to-date, fast-forward, three-way, or unrelated (an empty base)."""
    best = common_ancestor(parents, ours, theirs).first()
    if best is None:
        return "unrelated", None
    base = best["commit"]
    return ("up-to-date" if base == theirs else "fast-forward" if base == ours else "three-way"), base
