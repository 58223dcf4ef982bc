"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy (letters
folded to lower case). The index holds postings (trigram, document) for the trigrams that some query names; postings
are intersected per document, and rules are verified on their candidates only. A rule without mandatory trigrams, like
a run of hexadecimal digits, scans every text.

Defined cases: null text counts as empty (no spans); very long texts are scanned whole; repeated rows get the same
result each; a null doc_id is kept; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, text_or_empty

try:
    from re import _constants as sc
    from re import _parser as sp
except ImportError:  # Python before 3.11
    import sre_constants as sc
    import sre_parse as sp


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least length of a group (0: the whole match) for a match to count.
    group: int = 0
    least: int = 0
    base: bool = False


#: The first three are the base rules, in the order in which ties of spans are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # runs of 24+: shorter runs fail, and runs never overlap
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query: True (no condition), a trigram, ("and", ...) or ("or", ...).
MOST_STRINGS = 64


def _all(parts) -> object:
    parts = sorted({p for p in parts if p is not True}, key=repr)
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts) -> object:
    parts = sorted(set(parts), key=repr)
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _needs(strings: set[str]) -> object:
    """What holds if one of the strings occurs."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(op, arg) -> set[str] | None:
    """All strings that a node may match, if they are few."""
    if op is sc.LITERAL:
        return {chr(arg).lower()}
    if op is sc.SUBPATTERN:
        return _sequence(arg[3])
    if op is sc.IN and all(k in (sc.LITERAL, sc.RANGE) for k, _ in arg):
        chars = {chr(c).lower() for k, v in arg for c in (range(v[0], v[1] + 1) if k is sc.RANGE else (v,))}
        return chars if len(chars) <= 8 else None
    if op is sc.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    if op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and arg[1] <= 5:
        one = _sequence(arg[2])
        if one is not None:
            out = {"".join(x) for k in range(arg[0], arg[1] + 1) for x in itertools.islice(itertools.product(one, repeat=k), MOST_STRINGS + 1)}
            return out if len(out) <= MOST_STRINGS else None
    return None


def _sequence(nodes) -> set[str] | None:
    found = {""}
    for op, arg in nodes:
        more = _strings(op, arg)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _query(nodes) -> object:
    """Runs of known strings in a sequence give their trigrams; what is unknown between them gives its own query."""
    parts, run = [], {""}
    for op, arg in nodes:
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        parts.append(_needs(run))
        run = more if more is not None else {""}
        if more is None and op is sc.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif more is None and op is sc.BRANCH:
            parts.append(_any(_query(x) for x in arg[1]))
        elif more is None and op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and arg[0] > 0:
            parts.append(_query(arg[2]))
    return _all([*parts, _needs(run)])


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that each match of the pattern satisfies; True if there is none."""
    return _query(sp.parse(pattern))


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


def _holds(query, present: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(present, query)
    parts = [_holds(q, present) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def build_index(texts: DataFrame, rules=RULES) -> DataFrame:
    """Postings (trigram, key) of texts (key, text) for all trigrams that the rules' queries name."""
    wanted = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    folded = texts.select("key", F.lower("text").alias("t"))
    return folded.select(F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda g: F.contains(F.col("t"), g))).alias("trigram"), "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """Per key with postings: one flag for each rule that has a query, true if the key's postings satisfy it."""
    asked = [(r, q) for r in rules if (q := trigram_query(r.pattern)) is not True]
    present = index.groupBy("key").agg(F.collect_set("trigram").alias("g"))  # at most as many as the queries name
    return present.select("key", *(_holds(q, F.col("g")).alias(f"may_{r.kind}") for r, q in asked))


def _spans(rule: Rule, number: int, text: Column, may: Column) -> Column:
    """Spans of the rule's matches: what lies between matches and the matches themselves give the places."""
    pattern = F.lit(rule.pattern)
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = found if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.zip_with(F.split(text, rule.pattern, -1), F.zip_with(found, counted, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))), lambda gap, x: F.struct(F.length(gap).alias("gap"), x.m.alias("m"), x.g.alias("g")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc.at + x.gap
        end = begin + F.coalesce(x.m, F.lit(0))
        hit = F.array(F.struct(begin.alias("start"), F.lit(number).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(x.g, F.lit(-1)) >= max(rule.least, 1), F.concat(acc.out, hit)).otherwise(acc.out).alias("out"))

    return F.when(may, F.aggregate(pieces, start, step, lambda acc: acc.out)).otherwise(none)


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, text, the carried columns, and found, an array of (start, rank, kind, end) in order of place."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *carry)
    # A key stands for equal (doc_id, text); should two differ and share one, both are merely verified for both.
    texts = texts.withColumn("key", F.xxhash64(F.col("doc_id"), F.col("text")))
    index = settle(build_index(texts, rules), "postings")
    flagged = texts.join(candidates(index, rules), "key", "left")
    columns = set(flagged.columns)
    spans = []
    for number, rule in enumerate(rules):
        may = F.coalesce(F.col(f"may_{rule.kind}"), F.lit(False)) if f"may_{rule.kind}" in columns else F.rlike("text", F.lit(rule.pattern))
        spans.append(_spans(rule, number, F.col("text"), may))
    return flagged.select("doc_id", "text", *carry, F.array_sort(F.concat(*spans)).alias("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal stretch of spans replaced by the mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc.at + 1).cast("int"), (x.start - acc.at).cast("int"))
        more = F.when(x.start >= acc.at, F.concat(acc.out, gap, F.lit(mark))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, x.end).alias("at"), more.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc.out, F.substring(text, (acc.at + 1).cast("int"), F.length(text)))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, finish))
