"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit on what remains.

Documents become token pieces; a piece's length is all that packing looks at, so the plan is made for counts of
lengths (never more than the capacity has values, whatever the input) and applied to pieces by their rank within
their length. The reduction goes through the lengths w from the longest down, with room r beside it, and fixes, as often
as counts allow, a set that dominates every other set holding w: w alone if nothing fits beside it; w with a piece of
exactly r; w with the longest piece that fits if no two fit; w with the longest two, if no three fit and no other two are
better at either place. A length without such a set is passed over; as fixed sets leave fewer pieces, the lengths are gone
through again until nothing more is fixed. The remainder is packed by best fit in decreasing order.

Defined cases: null text counts as empty (a piece of the end id only); repeated rows are packed each; a null doc_id is
kept; further columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, text_batches, text_or_empty, tidied
from .tokens import json_encoder, vocabulary

CAPACITY, END_ID = 2048, 0

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())])


@tidied
def _cut(batches: Iterator[pa.RecordBatch], vocab, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    encoder = json_encoder(vocab.value.decode())
    for batch in text_batches(batches, "text", 3 << 20):
        ids, counts = encoder.encode(batch.column("text"))
        data, rows, at = ids.astype("<u4").tobytes(), [], 0
        for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
            own, at = data[4 * at : 4 * (at + n)] + end_id.to_bytes(4, "little"), at + n
            first = (n + 1) % capacity or capacity
            for piece, end in enumerate(range(first, n + 2, capacity)):
                start = max(0, end - capacity) if piece else 0
                rows.append((doc_id, piece, start, end - start, own[4 * start : 4 * end], part, int(seen[end - start])))
                seen[end - start] += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PIECES.types)], schema=_PIECES)


def cut_pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), and its rank nth among the pieces of its length in its part."""
    vocab = vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return settle(rows.mapInArrow(lambda it: _cut(it, vocab, end_id, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, nth bigint"), "pieces")


Pattern = tuple[tuple[int, ...], int]


class _Counts:
    """How many pieces there are of each length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for w in lengths:
            self.n[w] -= times
            if not self.n[w]:
                del self.n[w]
                self.order.remove(w)

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the set can be taken at once."""
        return min(self.n.get(w, 0) // lengths.count(w) for w in set(lengths))

    def least(self, k: int, beside: int) -> int | None:
        """Sum of the k shortest pieces but for one of length beside; None if there are fewer."""
        total, left = 0, k
        for w in self.order:
            use = min(left, self.n[w] - (w == beside))
            total, left = total + w * use, left - use
            if not left:
                return total
        return None

    def longest(self, room: int, used: tuple[int, ...]) -> int | None:
        """The longest piece of at most room that is left when those used are away."""
        for i in range(bisect.bisect_right(self.order, room) - 1, -1, -1):
            if self.n[w := self.order[i]] > used.count(w):
                return w
        return None


def dominating(c: _Counts, w: int, capacity: int) -> tuple[int, ...] | None:
    """A set with w that dominates every other set with w; None if none of at most three is known to."""
    room = capacity - w
    a = c.longest(room, (w,))
    if a is None:
        return (w,)
    if a == room:
        return (w, a)
    two, three = c.least(2, w), c.least(3, w)
    if two is None or two > room:
        return (w, a)
    b = c.longest(room - a, (w, a))
    if b is not None and (three is None or three > room):
        half = c.longest(room // 2, (w,))  # the shorter of any two that fit is no longer than half
        if half is None or half <= b:
            return (w, a, b)
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed sets with how often each is taken, and the counts that remain."""
    c, fixed = _Counts(counts), []
    again = True
    while again:
        again = False
        for w in sorted(c.n, reverse=True):
            while w in c.n and (lengths := dominating(c, w, capacity)):
                # What makes the set dominate holds until a length of it runs out: others only get fewer.
                times = c.times(lengths)
                c.take(lengths, times)
                fixed.append((lengths, times))
                again = True
    return fixed, dict(c.n)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit in decreasing order, for whole counts of equal lengths at once."""
    open_: dict[int, list[Pattern]] = {}  # by room
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((pattern, times))

    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            i = bisect.bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
                use = min(times, left)
                if times > use:
                    put(room, pattern, times - use)
                put(room - w, (*pattern, w), use)
                left -= use
            else:  # no open sequence has room: full stacks of w, then one more
                each = capacity // w
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * w, (w,) * each, full)
                if rest:
                    put(capacity - rest * w, (w,) * rest, 1)
                left = 0
    return [x for room in rooms for x in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], int]:
    """All patterns, and how many of the first ones the reduction fixed."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity), len(fixed)


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each run of slots, the sequence of that rank, the offset in it."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for lengths, times in patterns:
        offset = 0
        for w in lengths:
            runs.setdefault(w, []).append((ranks.get(w, 0), base, offset))
            ranks[w] = ranks.get(w, 0) + times
            offset += w
        base += times
    return {w: tuple(np.array(x, np.int64) for x in zip(*rows)) for w, rows in runs.items()}


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (all columns but part and nth) with sequence_id and offset."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots = _slots(plan(totals, capacity)[0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for w in np.unique(length):
                firsts, bases_, offsets = slots[int(w)]
                own = np.flatnonzero(length == w)
                k = np.searchsorted(firsts, rank[own], "right") - 1
                sequence[own], offset[own] = bases_[k] + rank[own] - firsts[k], offsets[k]
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema.fields]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))
