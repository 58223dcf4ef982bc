"""Boolean filter trees over facets and searches, compiled to one Column per node flag row."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """op: eq, neq, contains, matches on a facet field, or search over columns of matches."""

    field: str
    op: str
    value: str
    enabled: bool = True
    negated: bool = False


@dataclass(frozen=True)
class Group:
    mode: str = "all"
    children: tuple = ()
    enabled: bool = True
    negated: bool = False


def is_pattern(value: str) -> bool:
    """Whether the JVM, which runs it, takes a value as a regular expression."""
    jvm = SparkSession.active().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(value)
    except IllegalArgumentException:
        return False
    return True


def leaves(tree) -> list[Rule]:
    if isinstance(tree, Rule):
        return [tree] if tree.enabled else []
    return [r for c in tree.children for r in leaves(c)] if tree.enabled else []


@dataclass(frozen=True)
class Filter:
    """A tree over nodes whose facet fields are string or array columns."""

    tree: Group
    fields: tuple[str, ...]
    searches: dict[str, Column] = field(default_factory=dict)

    def _values(self, name: str, nodes: DataFrame) -> Column:
        kind = dict(nodes.dtypes)[name]
        return F.col(name) if kind.startswith("array") else F.filter(F.array(F.col(name).cast("string")), lambda x: x.isNotNull())

    def _rule(self, r: Rule, nodes: DataFrame) -> Column:
        if r.op == "search":
            out = F.coalesce(self.searches.get(r.value, F.lit(False)), F.lit(False))
        elif r.field not in self.fields:
            out = F.lit(False)  # an unknown field matches nothing, even by inequality
        else:
            v = self._values(r.field, nodes)
            if r.op in ("eq", "neq"):
                out = F.coalesce(F.array_contains(v, r.value), F.lit(False))
                out = ~out if r.op == "neq" else out
            elif r.op == "contains":
                out = F.coalesce(F.exists(v, lambda x: F.contains(F.lower(x), F.lit(r.value.lower()))), F.lit(False))
            else:
                if not is_pattern(r.value):
                    return F.lit(False)
                out = F.coalesce(F.exists(v, lambda x: x.rlike(r.value)), F.lit(False))
        return ~out if r.negated else out

    def column(self, nodes: DataFrame, tree=None) -> Column:
        tree = self.tree if tree is None else tree
        if isinstance(tree, Rule):
            return self._rule(tree, nodes)
        out = F.lit(tree.mode == "all")
        for c in tree.children:
            if c.enabled:
                out = out & self.column(nodes, c) if tree.mode == "all" else out | self.column(nodes, c)
        return ~out if tree.negated else out

    def apply(self, nodes: DataFrame) -> DataFrame:
        """The matching nodes; without an enabled rule there is no filter."""
        return nodes.filter(self.column(nodes)) if leaves(self.tree) else nodes

    def counts(self, nodes: DataFrame) -> DataFrame:
        """One row: the number of matches of every enabled rule and group, by its path in the tree."""
        found: list[Column] = []

        def walk(t, path: str) -> None:
            found.append(F.count_if(self.column(nodes, t)).alias(path))
            for i, c in enumerate(getattr(t, "children", ())):
                if c.enabled:
                    walk(c, f"{path}_{i}")

        walk(self.tree, "root")
        return nodes.agg(*found)

    def problems(self) -> list[tuple[str, str]]:
        out = []

        def walk(t, path: str) -> None:
            if isinstance(t, Group):
                if not t.children:
                    out.append((path, "empty group"))
                for i, c in enumerate(t.children):
                    walk(c, f"{path}_{i}")
            elif not t.value.strip():
                out.append((path, "blank search" if t.op == "search" else "blank value"))
            elif t.op == "search" and t.value not in self.searches:
                out.append((path, "search unavailable"))
            elif t.op != "search" and t.field not in self.fields:
                out.append((path, "unknown field"))
            elif t.op == "matches":
                if not is_pattern(t.value):
                    out.append((path, "bad pattern"))

        walk(self.tree, "root")
        return out


def edit(tree: Group, path: tuple[int, ...], change) -> Group:
    """The tree with the node at the path replaced by change(node), or removed where that is None; empty groups go too."""
    if not path:
        return change(tree)
    i, kids = path[0], list(tree.children)
    new = change(kids[i]) if len(path) == 1 else edit(kids[i], path[1:], change)
    kids[i : i + 1] = [] if new is None or (isinstance(new, Group) and not new.children) else [new]
    return replace(tree, children=tuple(kids))


def insert(tree: Group, path: tuple[int, ...], at: int, node) -> Group:
    """The tree with a node put at a place among the children of the group at the path."""
    if not path:
        return replace(tree, children=(*tree.children[:at], node, *tree.children[at:]))
    kids = list(tree.children)
    kids[path[0]] = insert(kids[path[0]], path[1:], at, node)
    return replace(tree, children=tuple(kids))


def at_path(tree, path: tuple[int, ...]):
    for i in path:
        tree = tree.children[i]
    return tree


def move(tree: Group, path: tuple[int, ...], into: tuple[int, ...], at: int) -> Group:
    """The node at a path taken to a place in the group at another; into itself or below it is refused. Both are places in the tree as it is; groups left empty go."""
    if into[: len(path)] == path:
        raise ValueError("a group cannot be moved into itself")
    node, mark = at_path(tree, path), Rule("", "moved", "")
    marked = edit(tree, path, lambda _: mark)
    placed = insert(marked, into, at, node)

    def without(t):
        if t is mark:
            return None
        if isinstance(t, Rule):
            return t
        kids = tuple(k for k in map(without, t.children) if k is not None)
        return replace(t, children=kids) if kids or t is placed else None

    return without(placed) or Group(tree.mode)


def toggled(tree: Group, path: tuple[int, ...]) -> Group:
    """The tree with the node at the path switched on or off."""
    return edit(tree, path, lambda n: replace(n, enabled=not n.enabled))


def cleared(tree: Group) -> Group:
    return replace(tree, children=())


def from_chips(chips: dict[str, list[str]], within: str = "any", across: str = "all") -> Group:
    """Facet chips: any or all of a field's values, all or any of the fields."""
    named = {"tag": "tags", "name": "title"}
    return Group(across, tuple(Group(within, tuple(Rule(named.get(f, f), "eq", v) for v in vs)) for f, vs in chips.items()))


def active_equalities(tree: Group) -> set[tuple[str, str]]:
    return {(r.field, r.value) for r in leaves(tree) if r.op == "eq" and not r.negated}


def facet_members(nodes: DataFrame, fields: list[str], idx: str = "idx") -> DataFrame:
    """facets(field, value, idx): the inverted index, values trimmed, empty ones dropped."""
    kinds, parts = dict(nodes.dtypes), None
    for f in fields:
        v = F.explode(f) if kinds[f].startswith("array") else F.col(f)
        rows = nodes.select(F.lit(f).alias("field"), F.col(idx).alias("idx"), v.cast("string").alias("value")).withColumn("value", F.trim("value")).filter("value <> ''").distinct()
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def facet_catalog(members: DataFrame) -> DataFrame:
    """field, value, nodes, ordered by count and value within a field."""
    return members.groupBy("field", "value").agg(F.count("*").alias("nodes")).orderBy("field", F.desc("nodes"), "value")
