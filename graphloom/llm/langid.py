"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text recognises every substring of it. A text is parsed greedily: a
phrase goes on as long as the automaton knows it, so phrases are longest matches, and the fewer are needed the closer
the languages. Phrases per symbol are divided by what held-back labelled text of that language itself needs; the
least wins, and the score is one less its ratio to the second. Texts are parsed in windows of 1024 symbols, all
windows of a batch and all languages in step; then each window is parsed again from where the one before really ended,
until both parses meet, so the phrases counted are those of the whole text.

The model is fitted on a bounded sample: at most SAMPLE_SYMBOLS symbols over all languages, from labelled rows with the
least hashes of each language, PIECE code points of each (fewer, but at least LEAST_PIECE, if there are so many languages
that two pieces of each would exceed the sample) and equal ones once, so that no piece held back is a copy of a learnt
one; every text is predicted whole. All letters of the sample are told apart: transitions by the 254 most frequent ones
are kept in a table, those by others as sorted keys.

Defined cases: `und` with score 0 for null, empty and letterless texts; a text in unknown letters gets the first
language by name at score 0; ties go to the first name; repeated rows get the same result each; without labelled rows
all are `und`; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, text_batches, tidied

SAMPLE_SYMBOLS, PIECE, LEAST_PIECE, WINDOW, HELD_BACK = 200_000, 2000, 50, 1024, 6
#: Classes of symbols: unknown letters and the space that stands for a run of other characters.
UNKNOWN, GAP, FIRST = 0, 1, 2
#: Classes that have a column in the table of transitions.
DENSE = 256


_letters: list[np.ndarray] = []


def kinds_of(letters: list[str]) -> np.ndarray:
    """Class of each code point: known letters from FIRST on, other letters, and all else."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    kinds = np.where(_letters[0], UNKNOWN, GAP).astype(np.int32)
    kinds[[ord(c) for c in letters]] = range(FIRST, FIRST + len(letters))
    return kinds


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Classes of the lower-cased text; a run of characters that are no letters is one gap."""
    kinds = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = kinds != GAP
    keep[1:] |= kinds[:-1] != GAP
    return kinds[keep]


def automaton(text: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton of text: a table of state by class below size, 0 for none, and (state, class, to) of other classes; state 1 is the start."""
    move: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in text:
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = twin
                while p and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
        last = cur
    table = np.zeros((len(move), size), np.int32)
    others = []
    for state, row in enumerate(move):
        for c, to in row.items():
            if c < size:
                table[state, c] = to
            else:
                others.append((state, c, to))
    return table, np.array(others, np.int64).reshape(-1, 3)


class Model:
    """Automata of all languages in one table whose entries are places of rows in it."""

    def __init__(self, sample: dict[str, list[str]], dense: int = DENSE):
        self.langs = sorted(sample)
        often = Counter(c for texts in sample.values() for t in texts for c in t.lower() if c.isalpha())
        letters = sorted(often, key=lambda c: (-often[c], c))
        self.kinds, self.all = kinds_of(letters), FIRST + len(letters)
        size = self.size = min(dense, self.all)
        # Pieces that differ in case or between letters only are copies too.
        sample = {lang: list({symbols(t, self.kinds).tobytes(): t for t in reversed(texts)}.values())[::-1] for lang, texts in sample.items()}
        tables, rest, self.starts, base, self.rate = [], [np.zeros((0, 2), np.int64)], [], 0, np.ones(len(self.langs))
        for lang in self.langs:
            kept = [t for i, t in enumerate(sample[lang]) if i % HELD_BACK or len(sample[lang]) < 2]
            own = symbols("\n".join(kept), self.kinds)
            table, others = automaton(own[own != UNKNOWN].tolist(), size)
            tables.append(np.where(table, table * size + base, 0).ravel())
            rest.append(np.stack([(others[:, 0] * size + base) * self.all + others[:, 1], others[:, 2] * size + base], axis=1))
            self.starts.append(base + size)
            base += table.size
        self.table = np.concatenate([*tables, np.zeros(size, np.int64)]).astype(np.int32)
        keys = np.concatenate(rest)
        self.keys, self.to = (keys[np.argsort(keys[:, 0])].T if len(keys) else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        every = np.arange(self.all, dtype=np.int32)
        self.fresh = np.array([np.where((row := self._step(np.full((1, self.all), s, np.int32), every)[0]) == 0, s, row) for s in self.starts], np.int32).reshape(len(self.langs), self.all)
        for k, lang in enumerate(self.langs):
            back = [t for i, t in enumerate(sample[lang]) if not i % HELD_BACK]
            parsed = [symbols(t, self.kinds) for t in back]
            total = sum(map(len, parsed))
            if total:
                self.rate[k] = max(self.phrases(parsed)[:, k].sum() / total, 1e-6)

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where classes c lead from states (languages by lanes); 0 for nowhere."""
        if self.all <= self.size:
            return self.table[state + c]
        rare = np.flatnonzero(c >= self.size)
        to = self.table[state + np.where(c < self.size, c, UNKNOWN)]
        if len(rare) and len(self.keys):
            want = state[:, rare].astype(np.int64) * self.all + c[rare]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            to[:, rare] = np.where(self.keys[at] == want, self.to[at], 0)
        return to

    def _go(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after classes c, and whether a phrase ended before them."""
        to = self._step(state, c)
        ends = to == 0
        return np.where(ends, self.fresh[:, c], to), ends

    def phrases(self, parsed: list[np.ndarray]) -> np.ndarray:
        """Phrases of each sequence of symbols by language."""
        langs = len(self.langs)
        out = np.zeros((len(parsed), langs), np.int64)
        lens = np.array([len(x) for x in parsed], np.int64)
        if not lens.sum() or not langs:
            return out
        flat = np.concatenate(parsed)
        windows = -(-lens // WINDOW)
        owner = np.repeat(np.arange(len(parsed)), windows)
        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = (np.cumsum(lens) - lens)[owner] + nth * WINDOW
        size = np.minimum(lens[owner] - nth * WINDOW, WINDOW)
        order = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[order], -np.arange(int(size.max())), "left")
        start = np.array(self.starts, np.int32)[:, None]
        state, count = np.repeat(start, len(owner), axis=1), np.zeros((langs, len(owner)), np.int64)
        for t, m in enumerate(active.tolist()):
            state[:, :m], ends = self._go(state[:, :m], flat[begin[order[:m]] + t])
            count[:, :m] += ends
        back = np.argsort(order)
        state, count = state[:, back], count[:, back]
        self._rejoin(flat, begin, size, nth, state, count)
        for k in range(langs):
            out[:, k] = np.bincount(owner, count[k], len(parsed)).astype(np.int64) + (lens > 0)
        return out

    def _rejoin(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, nth: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """Set counts and last states to what they are when each window goes on where the one before ended."""
        start = np.array(self.starts, np.int32)[:, None]
        more = np.zeros_like(count)
        lanes = np.flatnonzero(nth > 0)
        true = state.copy()  # at the end of each window, as far as known
        while len(lanes):
            fresh, real, own = np.repeat(start, len(lanes), axis=1), true[:, lanes - 1], lanes
            more[:, lanes] = 0
            met = np.zeros(0, np.int64)
            for t in range(WINDOW):
                apart = np.flatnonzero((fresh != real).any(axis=0) & (size[own] > t))
                done = np.setdiff1d(np.arange(len(own)), apart, assume_unique=True)
                met = np.concatenate([met, own[done]])
                left = done[(fresh[:, done] != real[:, done]).any(axis=0)]
                true[:, own[left]] = real[:, left]
                own, fresh, real = own[apart], fresh[:, apart], real[:, apart]
                if not len(own):
                    break
                c = flat[begin[own] + t]
                fresh, a = self._go(fresh, c)
                real, b = self._go(real, c)
                more[:, own] += b.astype(np.int64) - a
            true[:, own] = real  # these went through the whole window
            changed = np.flatnonzero((true != state).any(axis=0))
            state[:] = true
            lanes = changed + 1
            lanes = lanes[lanes < len(nth)]
            lanes = lanes[nth[lanes] > 0]
        count += more

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        parsed = [symbols(t, self.kinds) if t else np.zeros(0, np.int32) for t in texts]
        lettered = np.array([bool((x != GAP).any()) for x in parsed], bool)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = self.phrases(parsed) / self.rate
        best = cost.argmin(axis=1)
        if len(self.langs) > 1:
            two = np.partition(cost, 1, axis=1)
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
        else:
            score = np.ones(len(texts))
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, np.clip(score, 0, 1), 0.0).tolist()


def fit_sample(labelled: DataFrame) -> dict[str, list[str]]:
    """Labelled pieces of text by language from rows (lang, text), bounded as the module says."""
    rows = labelled.filter("lang is not null and length(text) > 0")
    langs = rows.agg(F.approx_count_distinct("lang")).first()[0]
    each = max(2, SAMPLE_SYMBOLS // PIECE // max(1, langs))
    size = min(PIECE, max(LEAST_PIECE, SAMPLE_SYMBOLS // (2 * max(1, langs))))
    first = Window.partitionBy("lang").orderBy("h")
    pieces = rows.select("lang", F.left("text", F.lit(size)).alias("piece")).withColumn("h", F.xxhash64(F.lower("piece")))
    least = pieces.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= each)
    chosen = pieces.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "n").agg(F.min("piece").alias("piece")).collect()  # each per language
    sample: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["n"])):
        sample.setdefault(r["lang"], []).append(r["piece"])
    return sample


def predict(docs: DataFrame, sample: dict[str, list[str]], carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The carried columns with lang_pred and score."""
    shipped, name = docs.sparkSession.sparkContext.broadcast(sample), uuid.uuid4().hex

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(("languages", name), lambda: Model(shipped.value))
        for batch in text_batches(batches, "_text", 2 << 20):
            langs, scores = model.predict(batch.column("_text").to_pylist())
            kept = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept.schema.names, "lang_pred", "score"])

    rows = docs.select(*carry, F.col(text_col).cast("string").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema.fields]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def identify(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from documents whose fold is not 2, predict all."""
    return predict(docs, fit_sample(docs.filter(fold() != 2).select("lang", "text")), carry)
