"""A store of versions: branches of commits, each a snapshot of nodes and edges, as append-only tables below one folder."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from . import versions

TABLES = {
    "commits": "seq bigint, commit string, change string, ts bigint, message string",
    "parents": "commit string, parent string, nth int",
    "branches": "seq bigint, name string, head string",
    "nodes": "commit string, id string, body string",
    "edges": "commit string, src string, dst string",
    "conflicts": "commit string, id string, base string, ours string, theirs string",
    "ops": "seq bigint, kind string, payload string",
}


def _name(kind: str, *parts) -> str:
    return f"{kind}-{hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]}"


class Store:
    """Operations on branches. A commit is written whole before its branch moves, so what fails before that leaves the branch as it was."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")

    def _append(self, name: str, rows: DataFrame | list[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, TABLES[name])
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    def _next(self) -> int:
        return (self.table("ops").agg(F.max("seq")).first()[0] or 0) + 1

    def _log(self, kind: str, **payload) -> int:
        seq = self._next()
        self._append("ops", [(seq, kind, json.dumps(payload, sort_keys=True))])
        return seq

    def branches(self) -> DataFrame:
        """name, head: the last state of each branch."""
        return self.table("branches").groupBy("name").agg(F.max_by("head", "seq").alias("head"))

    def head(self, branch: str) -> str | None:
        row = self.branches().filter(F.col("name") == branch).first()
        return row["head"] if row else None

    def create_branch(self, name: str, at: str) -> None:
        if self.branches().filter(F.col("name") == name).limit(1).count():
            raise ValueError(f"branch {name} exists")
        self._move(name, at, "branch")

    def _move(self, branch: str, head: str, kind: str) -> None:
        seq = self._log(kind, branch=branch, head=head)
        self._append("branches", [(seq, branch, head)])

    def snapshot(self, commit: str | None) -> tuple[DataFrame, DataFrame]:
        """nodes(id, body) and edges(src, dst) of a commit; both empty for none."""
        own = lambda name, *cols: self.table(name).filter(F.col("commit") == F.lit(commit)).select(*cols)
        return own("nodes", "id", "body"), own("edges", "src", "dst")

    def conflicts(self, commit: str | None) -> DataFrame:
        return self.table("conflicts").filter(F.col("commit") == F.lit(commit)).drop("commit")

    def _write(self, branch: str, nodes: DataFrame, edges: DataFrame, parents: list[str], message: str, ts: int, conflicts: DataFrame | None = None, change: str | None = None, kind: str = "commit") -> str:
        seq = self._next()
        commit = _name("c", seq, branch, parents, message, ts)
        tag = F.lit(commit).alias("commit")
        self._append("nodes", nodes.select(tag, "id", "body"))
        self._append("edges", edges.select(tag, "src", "dst").distinct())
        if conflicts is not None:
            self._append("conflicts", conflicts.select(tag, "id", "base", "ours", "theirs"))
        self._append("parents", [(commit, p, i) for i, p in enumerate(parents)])
        self._append("commits", [(seq, commit, change or _name("x", seq, branch, message, ts), ts, message)])
        self._move(branch, commit, kind)
        return commit

    def commit(self, branch: str, node_ops: DataFrame | None = None, edge_ops: DataFrame | None = None, message: str = "", ts: int = 0) -> str:
        """Apply ops(seq, kind, id, body) and ops(seq, kind, src, dst) to the branch's head; a missing branch begins empty, open conflicts stay open."""
        head = self.head(branch)
        nodes, edges = self.snapshot(head)
        nodes = nodes if node_ops is None else versions.apply_nodes(nodes, node_ops)
        edges = edges if edge_ops is None else versions.apply_edges(edges, edge_ops)
        return self._write(branch, nodes, edges, [head] if head else [], message, ts, self.conflicts(head))

    def log(self, branch: str, limit: int = 100) -> DataFrame:
        """place, commit, change, ts, message along first parents, newest first."""
        head = self.head(branch)
        if head is None:
            return self.spark.createDataFrame([], "place int, commit string, change string, ts bigint, message string")
        places = versions.first_parent_log(self.table("parents"), head, limit)
        return places.join(self.table("commits"), "commit").select("place", "commit", "change", "ts", "message").orderBy("place")

    def attributes(self, branch: str) -> DataFrame:
        """The commit that a branch's name leads to, with its change, time and message."""
        return self.branches().filter(F.col("name") == branch).join(self.table("commits"), F.col("head") == F.col("commit")).select("name", "commit", "change", "ts", "message")

    def merge(self, ours: str, theirs: str, message: str = "merge", ts: int = 0) -> tuple[str, str]:
        """Merge branch theirs into ours: what was done (up-to-date, fast-forward, three-way, unrelated), and the head then."""
        a, b = self.head(ours), self.head(theirs)
        if b is None:
            raise LookupError(f"no branch {theirs}")
        if a is None:
            self._move(ours, b, "merge")
            return "fast-forward", b
        kind, base = versions.merge_kind(self.table("parents"), a, b)
        if kind == "up-to-date":
            return kind, a
        if kind == "fast-forward":
            self._move(ours, b, "merge")
            return kind, b
        (n0, e0), (n1, e1), (n2, e2) = self.snapshot(base), self.snapshot(a), self.snapshot(b)
        merged = versions.merge_nodes(n0, n1, n2)
        nodes = merged.filter("body is not null").select("id", "body")
        open_ = merged.filter("not clean").select("id", "base", "ours", "theirs").unionByName(self.conflicts(a)).dropDuplicates(["id"])
        return kind, self._write(ours, nodes, versions.merge_edges(e0, e1, e2), [a, b], message, ts, open_, kind="merge")

    def rebase(self, branch: str, onto: str) -> str:
        """Replay the commits of branch that onto lacks on top of onto, by what each changed against its first parent; changes keep their ids."""
        head, target = self.head(branch), self.head(onto)
        if head is None or target is None:
            raise LookupError("both branches must have a commit")
        parents = self.table("parents")
        todo = [r["commit"] for r in versions.replayed(parents, head, target).collect()]  # the branch's own commits
        facts = {r["commit"]: r for r in self.table("commits").filter(F.col("commit").isin(todo)).collect()}
        first = {r["commit"]: r["parent"] for r in parents.filter("nth = 0").filter(F.col("commit").isin(todo)).collect()}
        now = target
        for old in todo:
            (n0, e0), (n1, e1), (n2, e2) = self.snapshot(first.get(old)), self.snapshot(now), self.snapshot(old)
            merged = versions.merge_nodes(n0, n1, n2)
            open_ = merged.filter("not clean").select("id", "base", "ours", "theirs")
            now = self._write(branch, merged.filter("body is not null").select("id", "body"), versions.merge_edges(e0, e1, e2), [now], facts[old]["message"], facts[old]["ts"], open_, facts[old]["change"], "rebase")
        if not todo:
            self._move(branch, target, "rebase")
        return now

    def resolve(self, branch: str, choices: DataFrame, message: str = "resolve", ts: int = 0) -> str:
        """Settle open conflicts by choices(id, choice, body)."""
        head = self.head(branch)
        nodes, edges = self.snapshot(head)
        asked = self.conflicts(head).join(choices.withColumnRenamed("body", "chosen"), "id")
        body = F.when(F.col("choice") == "ours", F.col("ours")).when(F.col("choice") == "theirs", F.col("theirs")).when(F.col("choice") == "explicit", F.col("chosen"))
        settled = asked.select("id", body.alias("body"))
        kept = nodes.join(settled.select("id"), "id", "left_anti").unionByName(settled.filter("body is not null"))
        return self._write(branch, kept, edges, [head], message, ts, self.conflicts(head).join(settled.select("id"), "id", "left_anti"), kind="resolve")

    def export(self) -> dict[str, DataFrame]:
        """Format 1: branches, and the commits on any branch's first-parent log, parents first (place), with their parents, nodes and edges."""
        parents, heads = self.table("parents"), self.branches()
        seen = None
        for r in heads.collect():  # branches
            own = versions.first_parent_log(parents, r["head"], 1 << 30).select("commit")
            seen = own if seen is None else seen.union(own)
        seen = self.spark.createDataFrame([], "commit string") if seen is None else seen.distinct()
        kept = parents.join(seen, "commit", "left_semi").join(seen.select(F.col("commit").alias("parent")), "parent", "left_semi").select("commit", "parent", "nth")
        level = versions.topological(seen, kept)
        own = lambda name: self.table(name).join(seen, "commit", "left_semi")
        return {"branches": heads, "commits": own("commits").join(level.withColumnRenamed("level", "place"), "commit"), "parents": kept, "nodes": own("nodes"), "edges": own("edges"), "conflicts": own("conflicts"), "ops": self.table("ops")}

    def restore(self, tables: dict[str, DataFrame]) -> None:
        """Fill an empty store from an export; a parent that is missing or placed no earlier than its child is refused."""
        if self.branches().limit(1).count():
            raise ValueError("the store is not empty")
        place = tables["commits"].select("commit", "place")
        upper = place.select(F.col("commit").alias("parent"), F.col("place").alias("at"))
        bad = tables["parents"].join(place, "commit").join(upper, "parent", "left").filter("at is null or at >= place")
        if bad.limit(1).count():
            raise ValueError("an export needs parents before their children")
        for name in ("nodes", "edges", "conflicts", "parents", "ops"):
            self._append(name, tables[name].select(*self.table(name).columns))
        self._append("commits", tables["commits"].select("seq", "commit", "change", "ts", "message"))
        self._append("branches", tables["branches"].select(F.lit(self._next()).cast("long").alias("seq"), "name", "head"))

    def world(self, name: str, branch: str = "main") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The branch's head as a source: nodes(id, title, kind), edges(src, dst), docs(id, title, kind, body) and edges that miss an end.

        Ids are led by `world:` and the name's slug; a blank title is the local id, a missing type is `note`; without commits all are empty.
        """
        nodes, edges = self.snapshot(self.head(branch))
        lead = F.concat(F.lit("world:"), slug(F.lit(name)), F.lit(":"))
        field = lambda k: F.get_json_object("body", f"$.{k}")
        title = F.coalesce(F.when(F.trim(field("title")) != "", field("title")), F.col("id"))
        rows = nodes.select(F.concat(lead, F.col("id")).alias("id"), title.alias("title"), F.coalesce(field("type"), F.lit("note")).alias("kind"), "body")
        ends = edges.select(F.concat(lead, F.col("src")).alias("src"), F.concat(lead, F.col("dst")).alias("dst"))
        ids = rows.select("id")
        whole = ends.join(ids, ends.src == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi")
        loose = ends.join(whole, ["src", "dst"], "left_anti")
        return rows.drop("body"), whole, rows, loose


def merged_graphs(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes(id, body) and edges(src, dst) of two graphs; of nodes with the same id the right one's body."""
    both = left[0].withColumn("_side", F.lit(0)).unionByName(right[0].withColumn("_side", F.lit(1)))
    nodes = both.groupBy("id").agg(F.max_by("body", "_side").alias("body"))
    return nodes, left[1].unionByName(right[1]).distinct()
