"""Ranked and cut lists over nodes, tags and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def subsequence_score(text: Column, query: str) -> Column:
    """How well the bytes of the query, lower-cased, occur in order in the text; null if they do not. Each is taken at its first place after the last one: 5 if right behind it, else 1, and 2 more among the first eight."""
    state = F.struct(F.lit(0).alias("score"), F.lit(-2).alias("last"), F.lit(True).alias("ok"))
    letters = F.array(*(F.lit(c) for c in query.lower())) if query else F.expr("cast(array() as array<string>)")
    low = F.lower(text)

    def step(s: Column, c: Column) -> Column:
        at = F.call_function("locate", c, low, F.greatest(s.last + 1, F.lit(0)) + 1) - 1
        found = s.ok & (at >= 0)
        gain = F.when(at == s.last + 1, 5).otherwise(1) + F.when(at < 8, 2).otherwise(0)
        return F.struct((s.score + F.when(found, gain).otherwise(0)).alias("score"), F.when(found, at).otherwise(s.last).alias("last"), found.alias("ok"))

    return F.aggregate(letters, state, step, lambda s: F.when(s.ok, s.score))


def ranked_actions(actions: DataFrame, query: str) -> DataFrame:
    """actions(id, title, description, keywords) that the query fits, by three times the title's score plus that of all else, then title."""
    extras = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.array_join("keywords", " "), "id")
    title, rest = subsequence_score(F.col("title"), query), subsequence_score(extras, query)
    rated = actions.withColumns({"_t": title, "_e": rest}).filter("_t is not null or _e is not null")
    return rated.withColumn("score", 3 * F.coalesce("_t", F.lit(0)) + F.coalesce("_e", F.lit(0))).drop("_t", "_e").orderBy(F.desc("score"), "title")


def top_tags(members: DataFrame, query: str = "", fuzzy=None, k: int = 80) -> DataFrame:
    """tag, nodes: the k tags of most nodes in members(idx, tag), ties by name; with a query those that it fits, by score, then nodes."""
    counts = members.groupBy("tag").agg(F.countDistinct("idx").alias("nodes"))
    if not query.strip():
        return counts.orderBy(F.desc("nodes"), "tag").limit(k)
    rated = counts.withColumn("score", (fuzzy or subsequence_score)(F.col("tag"), query.strip())).filter("score is not null")
    return rated.orderBy(F.desc("score"), F.desc("nodes"), "tag").limit(k).select("tag", "nodes")


def neighbour_pills(g: Graph, idx: int, k: int = 200) -> DataFrame:
    """The first k neighbours of a node with their direction, and how many are left out."""
    near = g.neighbourhood(idx)
    return near.limit(k).crossJoin(F.broadcast(near.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("left_out"))))  # one row


def all_neighbour_counts(g: Graph, k: int = 200) -> DataFrame:
    """idx, shown, left_out for the pills of every node."""
    near = g.neighbours().groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return g.nodes.select("idx").join(near, "idx", "left").select("idx", F.least(n, F.lit(k)).cast("long").alias("shown"), F.greatest(n - k, F.lit(0)).cast("long").alias("left_out"))


def label_order(rows: DataFrame, label: str) -> DataFrame:
    """rows by label without regard to case, then with it."""
    return rows.orderBy(F.lower(label), label)


def community_members(communities: DataFrame, idx: int) -> DataFrame:
    """idx of the nodes in the community of a node, itself included."""
    own = communities.filter(F.col("idx") == idx).select("community")
    return communities.join(F.broadcast(own), "community", "left_semi").select("idx")  # one row


def community_sizes(communities: DataFrame) -> DataFrame:
    """idx, community, members: how many nodes share a node's community."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("members"))
    return communities.join(sizes, "community").select("idx", "community", "members")


def relevant_path(path: Column) -> Column:
    """Whether a changed file matters: Markdown, with no folder or name on the way that begins with a dot."""
    return F.lower(path).rlike(r"\.(md|markdown)$") & ~path.rlike(r"(^|/)\.[^/]")


def nodes_of_set(rows: DataFrame) -> DataFrame:
    """A search result as a set: distinct idx in order."""
    return rows.select("idx").distinct().orderBy("idx")
