"""String, URL, JSON and hash columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType


def content_id(x: Column) -> Column:
    """h256: and the first 16 bytes of the SHA-256 in hex."""
    return F.concat(F.lit("h256:"), F.substring(F.sha2(x, 256), 1, 32))


def part_id(prefix: str, *parts: Column) -> Column:
    """prefix- and 16 hex digits of the SHA-256 of the parts, each closed by NUL."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat(*(F.concat(p, F.lit("\0")) for p in parts)), 256), 1, 16))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def csv_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), lambda v: F.trim(v)), lambda v: v != "")


def sorted_unique(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def tag_branches(tag: Column) -> Column:
    """All prefixes of a tag path; a tag with an empty segment is a branch of its own."""
    parts = F.split(tag, "/")
    return F.when(F.exists(parts, lambda p: p == ""), F.array(tag)).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def pointer(doc: Column, path: str) -> Column:
    """The trimmed text at an RFC 6901 pointer of JSON text; null if empty or absent."""
    keys = [k.replace("~1", "/").replace("~0", "~") for k in path.split("/")[1:]]
    at = "$" + "".join(f"[{k}]" if k.isdigit() else f"['{k}']" for k in keys)
    return F.nullif(F.trim(F.get_json_object(doc, at)), F.lit(""))


def skips(doc: Column, path: str, value: str, missing_matches: bool) -> Column:
    """Whether the text at a pointer equals the value without regard to ASCII case."""
    return F.coalesce(F.lower(pointer(doc, path)) == value.lower(), F.lit(missing_matches))


def kind_of(x: Column) -> Column:
    """wikilink, url, date, ticket or text."""
    return (
        F.when(x.rlike(r"^\[\[.*\]\]$"), "wikilink")
        .when(x.rlike(r"^https?://\S+$") & (F.length(x) < 2048), "url")
        .when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), "date")
        .when(x.rlike(r"^[A-Z][A-Z0-9]*-\d+$"), "ticket")
        .otherwise("text")
    )


def title(x: Column, id_: Column, most: int, prefix: str) -> Column:
    """The first line, cut to `most` characters (at its last space, if that is past byte most / 2) with an ellipsis; without one the prefix and 8 characters of the id."""
    line = F.trim(F.regexp_extract(F.coalesce(x, F.lit("")), r"^([^\n]*)", 1))
    head = F.left(line, F.lit(most))
    upto = F.regexp_extract(head, r"^(.*) [^ ]*$", 1)
    cut = F.when(head.contains(" ") & (F.octet_length(upto) > most // 2), upto).otherwise(head)
    return F.when(line == "", F.concat(F.lit(prefix + " "), F.left(id_, F.lit(8)))).when(F.length(line) <= most, line).otherwise(F.concat(cut, F.lit("…")))


def escaped(x: Column) -> Column:
    """Text for HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def short_id(x: Column, most: int = 24) -> Column:
    """What follows the last slash, at most so many characters."""
    return F.left(F.substring_index(x, "/", -1), F.lit(most))


def snippet(x: Column, words: list[str], around: int = 60) -> Column:
    """The surroundings of the first of the words (whole, in either case), each of them in <b>; null if there is none."""
    any_ = "|".join(re.escape(w) for w in words)
    near = F.regexp_extract(x, rf"(?is)(.{{0,{around}}}(?<![\p{{L}}\p{{N}}])(?:{any_})(?![\p{{L}}\p{{N}}]).{{0,{around}}})", 1)
    return F.nullif(F.regexp_replace(escaped(near), rf"(?i)(?<![\p{{L}}\p{{N}}])({any_})(?![\p{{L}}\p{{N}}])", "<b>$1</b>"), F.lit(""))


def wikilinks(text: str) -> list[str]:
    """Targets of [[target#heading|alias]], trimmed, without empty ones; one that is not closed runs to the end."""
    found = (m.group(1) for m in re.finditer(r"\[\[(.*?)(?:\]\]|\Z)", text, re.S))
    return [t for f in found if (t := re.split(r"[|#]", f, maxsplit=1)[0].strip())]


def frontmatter(text: str) -> tuple[str | None, str]:
    """The block between --- lines at the top and the rest; none if it is not closed."""
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|\Z)", text, re.S)
    return (m.group(1), text[m.end() :]) if m else (None, text)


def inline_tags(body: str) -> list[str]:
    """#tags outside fences and headings, with a letter, in order of first appearance."""
    out, fenced = {}, False
    for line in body.splitlines():
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and not re.match(r"#{1,6}\s", line):
            for m in re.finditer(r"(?:^|(?<=[\s(\[{,;]))#([A-Za-z0-9_/-]+)", line):
                if re.search("[A-Za-z]", m.group(1)):
                    out.setdefault(m.group(1).strip("/"))
    return list(out)


def fuzzy_score(query: str, text: str) -> int | None:
    """Subsequence score: 2 a match, 3 more if it follows the last, 2 more at a start of a word, less a 16th of the length."""
    q, t, at, last, score = query.lower(), text.lower(), 0, -2, 0
    for c in q:
        at = t.find(c, at)
        if at < 0:
            return None
        score += 2 + 3 * (at == last + 1) + 2 * (at == 0 or t[at - 1] in "/-_ .")
        last, at = at, at + 1
    return score - len(t) // 16


def fuzzy(query: str):
    @pandas_udf(IntegerType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fuzzy_score(query, v) for v in x], dtype="Int32")

    return score


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
