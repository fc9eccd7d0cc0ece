"""Packing of token pieces into sequences: dominance reduction, then best fit.

A piece matters for packing only by its length, so the instance is the table of lengths and counts, with at most
``capacity`` rows however many documents there are. ``plan`` works on it in bulk:

1. Reduction. A set of pieces is fixed as a sequence of its own where it dominates every other way to fill a sequence
   that holds its largest piece s: nothing fits beside s; the best single partner fills the sequence; no two pieces fit
   beside s, or no fitting pair is larger than the best partner (one partner then stands for any pair); or the best
   partner together with the largest piece that still fits is at least as large, piece by piece, as any fitting pair
   and no three fit. What is left only shrinks, so a set that dominates now still does so while its pieces last, and it
   is fixed as many times as they do.
2. Best fit of the remainder, largest first, with equal sequences kept as one entry.

The plan says which ranks of a length go where. Tasks number their own pieces per length, and the pieces of one length
are ranked by task: no piece moves, and no length is gathered, however many pieces share it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.llm.encoding import encoder
from sheetlens.llm.texts import as_texts, chunks
from sheetlens.session import ship_package, stage

Plan = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class _Slots:
    """Where the ranks of each length go: rows of (length, first rank, last rank + 1, first sequence, offset)."""

    def __init__(self, capacity: int):
        self.next_rank = [0] * (capacity + 1)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []

    def fix(self, lengths: tuple[int, ...], times: int) -> None:
        offset = 0
        for s in lengths:
            rank = self.next_rank[s]
            self.rows.append((s, rank, rank + times, self.sequences, offset))
            self.next_rank[s] = rank + times
            offset += s
        self.sequences += times


def _smallest(left: np.ndarray, sizes: np.ndarray, n: int) -> list[int]:
    out: list[int] = []
    for s in sizes[:n].tolist():
        out += [s] * min(n - len(out), int(left[s]))
        if len(out) == n:
            break
    return out


def _dominating(s: int, left: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """Lengths of a set around a piece of length ``s`` that no other set with it can beat, or None."""
    rest = left.copy()
    rest[s] -= 1
    room = capacity - s
    sizes = np.flatnonzero(rest)
    low = _smallest(rest, sizes, 3)
    if not low or low[0] > room:
        return (s,)
    best = int(sizes[np.searchsorted(sizes, room, "right") - 1])
    if best == room or len(low) == 1 or low[0] + low[1] > room:
        return (s, best)
    if len(low) == 3 and sum(low) <= room:
        return None
    # pairs may fit, triples do not
    partner_rest = rest
    largest_pair = 0
    for p in sizes[sizes <= room].tolist():
        partner_rest[p] -= 1
        q = sizes[: np.searchsorted(sizes, room - p, "right")]
        q = q[partner_rest[q] > 0]
        if len(q):
            largest_pair = max(largest_pair, p + int(q[-1]))
        partner_rest[p] += 1
    if largest_pair <= best:
        return (s, best)
    partner_rest[best] -= 1
    second = sizes[: np.searchsorted(sizes, room - best, "right")]
    second = second[partner_rest[second] > 0]
    partner_rest[best] += 1
    if not len(second):
        return None
    second = int(second[-1])
    above = np.flatnonzero(rest)
    above = above[above > second]
    two = _smallest(rest, above, 2)
    # any fitting pair has its smaller piece at most ``second``, its larger one at most ``best``
    if len(two) < 2 or sum(two) > room:
        return (s, best, second)
    return None


def reduce(left: np.ndarray, capacity: int, slots: _Slots) -> int:
    """Fix dominating sets until none is found; ``left`` loses their pieces. Returns the number of fixed sequences."""
    before = slots.sequences
    changed = True
    while changed:
        changed = False
        for s in np.flatnonzero(left)[::-1].tolist():
            while left[s] > 0:
                found = _dominating(s, left, capacity)
                if found is None:
                    break
                uses = {x: found.count(x) for x in found}
                times = min(int(left[x]) // k for x, k in uses.items())
                for x, k in uses.items():
                    left[x] -= times * k
                slots.fix(found, times)
                changed = True
    return slots.sequences - before


def best_fit(left: np.ndarray, capacity: int, slots: _Slots) -> None:
    """Best fit, largest first; sequences with equal contents are one entry (lengths, times) under their free room."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        open_.setdefault(room, []).append((lengths, times))
        rooms[room] = True

    for s in np.flatnonzero(left)[::-1].tolist():
        n = int(left[s])
        while n:
            fitting = np.flatnonzero(rooms[s:])
            if len(fitting):
                room = s + int(fitting[0])
                lengths, times = open_[room].pop()
                if not open_[room]:
                    rooms[room] = False
                took = min(n, times)
                if times > took:
                    put(room, lengths, times - took)
                put(room - s, (*lengths, s), took)
                n -= took
            else:
                each = min(n, capacity // s)
                put(capacity - each * s, (s,) * each, n // each)
                n %= each
        left[s] = 0
    for entries in open_.values():
        for lengths, times in entries:
            slots.fix(lengths, times)


def plan(counts: dict[int, int], capacity: int) -> tuple[Plan, int, int]:
    """(slots ordered by length and rank, number of sequences, sequences fixed by the reduction)."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    slots = _Slots(capacity)
    fixed = reduce(left, capacity, slots)
    best_fit(left, capacity, slots)
    rows = np.array(sorted(slots.rows), np.int64).reshape(-1, 5)
    return tuple(rows.T), slots.sequences, fixed


def _pieces(tokenizer_path: str, capacity: int, end_id: int):
    def run(batches):
        tool = encoder(tokenizer_path)
        task = TaskContext.get().partitionId()
        given = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at, texts in chunks(as_texts(batch.column("text"))):
                ids, bounds = tool.encode(texts, end_id)
                n = np.diff(bounds)
                times = (n + capacity - 1) // capacity
                doc = np.repeat(np.arange(len(n)), times)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                flat = memoryview(np.ascontiguousarray(ids.astype("<u4", copy=False))).cast("B")
                first = bounds[doc] + start
                crc = np.fromiter((zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())), np.int64, len(doc))
                order = np.argsort(length, kind="stable")
                sizes, begin, count = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(begin, count) + np.repeat(given[sizes], count)
                given[sizes] += count
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(n)).take(pa.array(doc)),
                        *map(pa.array, (piece.astype(np.int32), start, length, crc, np.full(len(doc), task, np.int32), rank)),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return run


def _place(slots):
    def run(batches):
        size, low, _, sequence, offset = slots.value
        key = (size << 44) | low
        for batch in batches:
            table = {c: batch.column(c) for c in batch.schema.names}
            rank = table["first"].to_numpy() + table["rank"].to_numpy()
            at = np.searchsorted(key, (table["length"].to_numpy() << 44) | rank, "right") - 1
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [table[c] for c in keep] + [pa.array(sequence[at] + rank - low[at]), pa.array(offset[at])], [*keep, "sequence_id", "offset"]
            )

    return run


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is its ids and then ``end_id``; only longer ones than ``capacity`` are cut, every ``capacity`` ids. A null
    text is an empty text and makes a piece of one id. Repeated rows are packed one by one, null doc_ids stay null, an
    empty table gives no rows. Other columns are not read. Only the table of lengths (at most ``capacity`` rows) and
    the plan made from it pass the driver.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stage(source.mapInArrow(_pieces(tokenizer_path, capacity, end_id), f"{PIECES}, task int, rank bigint"), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan(counts, capacity)[0])
    ranked = pieces.join(firsts, ["task", "length"])
    return ranked.mapInArrow(_place(slots), f"{PIECES}, sequence_id bigint, offset bigint")
