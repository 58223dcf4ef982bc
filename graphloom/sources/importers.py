"""The contract of importers, the read-decode-map chain behind it, what an importer may do, and fields found in notes and concepts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import frontmatter
from .notes import properties

EFFECTS, TRANSPORTS = ("read", "watch", "write", "search", "content"), ("file", "http", "memory", "table")


@dataclass(frozen=True)
class Loaded:
    """What an import gives: nodes(id, ...), edges(src, dst), docs(id, ...) to be searched, unresolved references."""

    nodes: DataFrame
    edges: DataFrame
    docs: DataFrame
    unresolved: DataFrame


@dataclass(frozen=True)
class Descriptor:
    name: str
    transport: str
    effects: tuple[str, ...] = ("read",)
    scope: str = ""


class Importer(Protocol):
    def descriptor(self) -> Descriptor: ...

    def load(self) -> Loaded: ...


@dataclass(frozen=True)
class Policy:
    """Grants (effect, transport, leading part of the scope). What is not granted is refused before anything is read."""

    grants: frozenset[tuple[str, str, str]] = frozenset()

    def check(self, d: Descriptor) -> None:
        for effect in d.effects:
            if effect not in EFFECTS or d.transport not in TRANSPORTS:
                raise ValueError(f"{d.name}: no effect {effect} over {d.transport}")
            if not any(e == effect and t == d.transport and d.scope.startswith(s) for e, t, s in self.grants):
                raise PermissionError(f"{d.name} may not {effect} {d.scope or 'anything'} over {d.transport}")


@dataclass(frozen=True)
class Chain:
    """An importer made of a connector that reads records, decoders of them in turn, and a mapper to a graph."""

    about: Descriptor
    connect: Callable[[], DataFrame]
    mapper: Callable[[DataFrame], Loaded]
    decoders: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    write: Callable[[Loaded], None] | None = None

    def descriptor(self) -> Descriptor:
        return self.about

    def load(self) -> Loaded:
        rows = self.connect()
        for decode in self.decoders:
            rows = decode(rows)
        out = self.mapper(rows)
        if self.write:
            self.write(out)
        return out


def run(importer: Importer, policy: Policy) -> Loaded:
    policy.check(importer.descriptor())
    return importer.load()


def decoded_json(rows: DataFrame, col: str, schema: str, strict: bool = False) -> DataFrame:
    """rows with `value`, the column parsed as JSON: strict fails at the first malformed one, else it becomes null."""
    value = F.from_json(col, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    malformed = F.expr(f"try_parse_json({col}) is null")
    return rows.withColumn("value", value if strict else F.when(malformed, F.lit(None)).otherwise(value))


def split_frontmatter(notes: DataFrame, strict: bool = False) -> DataFrame:
    """notes(path, text) with props (JSON of the frontmatter) and body. A block that is opened and not closed, or a line in it that is neither `key:`, a list item, blank nor a comment, fails if strict; else such a note has no props."""

    def bad(block: str) -> bool:
        return any(x.strip() and not x.startswith((" ", "\t", "#")) and not x.strip().startswith("- ") and ":" not in x for x in block.splitlines())

    def parse(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"], strict=True):
                block, body = frontmatter(text or "")
                wrong = (block is None and (text or "").startswith("---\n")) or (block is not None and bad(block))
                if wrong and strict:
                    raise ValueError(f"malformed frontmatter in {path}")
                rows.append((path, json.dumps({} if wrong else properties(block or ""), sort_keys=True), body))
            yield pd.DataFrame(rows, columns=["path", "props", "body"])

    return notes.select("path", "text").mapInPandas(parse, "path string, props string, body string")


def metadata_strings(props: Column, key: str, commas: bool = False) -> Column:
    """The trimmed, different, non-empty strings of a field that is a string or a list of strings."""
    raw = F.get_json_object(props, f"$.{key}")
    listed = F.from_json(raw, "array<string>")
    values = F.when(raw.isNull(), F.expr("cast(array() as array<string>)")).when(F.startswith(raw, F.lit("[")) & listed.isNotNull(), listed).otherwise(F.array(raw))
    parts = F.flatten(F.transform(values, lambda x: F.split(x, ","))) if commas else values
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def normalized_related(value: Column) -> Column:
    """`[[Target|label]]` as Target; other text as it is, trimmed."""
    inner = F.regexp_extract(F.trim(value), r"^\[\[(.*)\]\]$", 1)
    return F.trim(F.substring_index(F.when(F.trim(value).rlike(r"^\[\[.*\]\]$"), inner).otherwise(F.trim(value)), "|", 1))


def discovery(notes: DataFrame) -> DataFrame:
    """Of notes(path, props, body): description, status, authors, entities, key_topics, related, folder and content_hash; what is not there is null."""
    p = F.col("props")
    some = lambda c: F.when(F.size(c) > 0, c)
    status = F.get_json_object(p, "$.status")
    related = F.filter(F.transform(metadata_strings(p, "related"), normalized_related), lambda x: x != "")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return notes.select(
        "path", F.get_json_object(p, "$.description").alias("description"), F.when(F.trim(status) != "", status).alias("status"),
        some(metadata_strings(p, "authors", True)).alias("authors"), some(metadata_strings(p, "entities")).alias("entities"),
        some(metadata_strings(p, "key_topics")).alias("key_topics"), some(related).alias("related"), F.when(folder != "", folder).alias("folder"),
        F.concat(F.lit("h256:"), F.left(F.sha2("body", 256), F.lit(32))).alias("content_hash"),
    )


def concept_discovery(rows: DataFrame, props: str = "props") -> DataFrame:
    """rows with verified (actors, sorted), trust, source_titles and source_authors (sorted), from JSON fields `verified` (an object or a list) and `sources`."""
    raw = F.get_json_object(props, "$.verified")
    entry, some = "struct<by:string>", lambda x: x.isNotNull() & (F.trim(x) != "")
    listed = F.when(F.startswith(raw, F.lit("{")), F.array(F.from_json(raw, entry))).otherwise(F.from_json(raw, f"array<{entry}>"))
    unique = lambda values: F.array_sort(F.array_distinct(F.filter(F.coalesce(values, F.expr("cast(array() as array<string>)")), some)))
    sources = F.from_json(F.get_json_object(props, "$.sources"), "array<struct<title:string,author:string>>")
    out = rows.withColumns({"verified": unique(F.transform(listed, lambda x: x.by)), "source_titles": unique(F.transform(sources, lambda x: x.title)), "source_authors": unique(F.transform(sources, lambda x: x.author))})
    human = F.exists("verified", lambda x: F.startswith(x, F.lit("human:")))
    return out.withColumn("trust", F.when(human, "human-reviewed").when(F.size("verified") == 0, "unverified").otherwise("machine-confirmed"))


@dataclass(frozen=True)
class DottedPath:
    """Leaf strings at a path like `sources[*].title`: `[*]` goes over a list, lists at the end are gone through, numbers, truth values and objects are no leaves."""

    path: str
    steps: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "steps", tuple(self.path.split(".")))

    def of(self, value: object) -> list[str]:
        return list(self._walk(value, self.steps))

    def _leaves(self, value: object) -> Iterable[str]:
        if isinstance(value, str):
            yield value
        elif isinstance(value, list):
            for x in value:
                yield from self._leaves(x)

    def _walk(self, value: object, steps: tuple[str, ...]) -> Iterable[str]:
        name, rest = steps[0], steps[1:]
        if name.endswith("[*]"):
            held = value if name == "[*]" else value.get(name[:-3]) if isinstance(value, dict) else None
            for x in held if isinstance(held, list) else ():
                yield from self._walk(x, rest) if rest else self._leaves(x)
            return
        there = isinstance(value, dict) and name in value
        if rest:
            yield from self._walk(value[name], rest) if there else ()
        else:
            yield from self._leaves(value[name] if there else value)


def path_strings(json_col: str, path: str) -> Column:
    """The strings at a dotted path of a JSON column, in order; none for what is no JSON."""
    walk = DottedPath(path)

    @F.pandas_udf("array<string>")
    def strings(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return walk.of(json.loads(v)) if v is not None else []
            except ValueError:
                return []

        return values.map(one)

    return strings(F.col(json_col))


def json_text(json_col: str, pointer: str) -> Column:
    """A JSON field as text: strings bare, other values as JSON, null for null and for what is not there."""
    raw = F.expr(f"try_variant_get(try_parse_json({json_col}), '$.{pointer.strip('/').replace('/', '.')}', 'string')")
    return raw
