"""Records of CSV files, cut in parallel from byte ranges.

A quoted value may hold line breaks, so whether a line begins a record depends on all that stands before it. Lines are read
by byte ranges, and every range is a function from the state at its start (outside or inside a quoted value) to the
state at its end. One pass finds these functions, a short composition of them per file gives each range's start state, and
a second pass cuts the lines into records. A record that goes on beyond its range is put together from one part per range.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetlens.session import ship_package, stage

OUTSIDE, INSIDE = 0, 1

# a value that starts with a quote goes on to the next single quote; others may hold quotes as ordinary characters
_VALUE = rb'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
_WHOLE_LINE = re.compile(_VALUE + rb"(?:," + _VALUE + rb")*+")
_CLOSING = re.compile(rb'(?:[^"]++|"")*+"')
_REST = re.compile(rb"[^,]*+(?:," + _VALUE + rb")*+")

LINE = "record binary, _file string, _from bigint"
PART = LINE + ", _at bigint, begins boolean"


def line_end(line: bytes, state: int) -> int:
    """State after a line that starts in ``state``."""
    if state == OUTSIDE:
        return OUTSIDE if _WHOLE_LINE.fullmatch(line) else INSIDE
    closed = _CLOSING.match(line)
    return OUTSIDE if closed and _REST.fullmatch(line, closed.end()) else INSIDE


def _by_range(batches):
    """(file, start of range, lines) for stretches of lines of one range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("_file").dictionary_encode(), batch.column("_from").to_numpy()
        at = files.indices.to_numpy()
        cuts = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield files.dictionary[at[a]].as_py(), int(starts[a]), batch.column("record").slice(a, b - a)


def _quoted(lines: pa.Array) -> np.ndarray:
    """Places of the lines that hold a quote; all others leave the state as it is."""
    return np.flatnonzero(pc.greater_equal(pc.find_substring(lines, b'"'), 0).to_numpy(zero_copy_only=False))


def _functions(batches):
    ends: dict[tuple[str, int], list[int]] = {}
    for file, start, lines in _by_range(batches):
        now = ends.setdefault((file, start), [OUTSIDE, INSIDE])
        for i in _quoted(lines):
            line = lines[i].as_py()
            now[:] = [line_end(line, now[0])] * 2 if now[0] == now[1] else [line_end(line, s) for s in now]
    rows = [(*key, *states) for key, states in ends.items()]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32()))]
    yield pa.RecordBatch.from_arrays(columns, ["_file", "_from", "from_outside", "from_inside"])


class _Cutter:
    """Lines of one range to records; keeps the lines of the record that is open."""

    def __init__(self, file: str, start: int, state: int):
        self.file, self.start, self.state = file, start, state
        self.headless = state == INSIDE  # the first lines belong to a record of an earlier range
        self.open: list[pa.Array] = []
        self.at = 0

    def cut(self, lines: pa.Array):
        after = np.empty(len(lines), np.int8)
        done = 0
        for i in _quoted(lines):
            after[done:i] = self.state
            self.state = line_end(lines[i].as_py(), self.state)
            after[i] = self.state
            done = i + 1
        after[done:] = self.state
        ends = np.flatnonzero(after == OUTSIDE)
        if not len(ends):
            self.open.append(lines)
            return
        held = sum(map(len, self.open))
        values = pa.concat_arrays([*self.open, lines.slice(0, ends[-1] + 1)])
        bounds = pa.array(np.concatenate([[0], ends + 1 + held]).astype(np.int32))
        whole = held == 0 and len(ends) == ends[-1] + 1
        records = values if whole else pc.binary_join(pa.ListArray.from_arrays(bounds, values), pa.scalar(b"\n", values.type))
        self.open = [lines.slice(ends[-1] + 1)] if ends[-1] + 1 < len(lines) else []
        if self.headless:
            self.headless = False
            yield self._batch(records.slice(0, 1), None, False)
            records = records.slice(1)
        if len(records):
            yield self._batch(records, self.at, None)
            self.at += len(records)

    def close(self):
        if self.open:
            lines = pa.concat_arrays(self.open)
            bounds = pa.array([0, len(lines)], pa.int32())
            yield self._batch(pc.binary_join(pa.ListArray.from_arrays(bounds, lines), pa.scalar(b"\n", lines.type)), self.at, not self.headless)

    def _batch(self, records, at, begins):
        n = len(records)
        numbers = pa.nulls(n, pa.int64()) if at is None else pa.array(np.arange(at, at + n))
        return pa.RecordBatch.from_arrays(
            [records.cast(pa.binary()), pa.array([self.file] * n, pa.string()), pa.array(np.full(n, self.start)), numbers, pa.array([begins] * n, pa.bool_())],
            ["record", "_file", "_from", "_at", "begins"],
        )


def _cut(states):
    def run(batches):
        begin = states.value
        cutter = None
        for file, start, lines in _by_range(batches):
            if cutter is None or (cutter.file, cutter.start) != (file, start):
                if cutter is not None:
                    yield from cutter.close()
                cutter = _Cutter(file, start, begin[file, start])
            yield from cutter.cut(lines)
        if cutter is not None:
            yield from cutter.close()

    return run


def start_states(functions: list) -> dict[tuple[str, int], int]:
    """State at the start of each range: the functions of the ranges before it in its file, one after the other."""
    out, file, state = {}, None, OUTSIDE
    for r in sorted(functions, key=lambda r: (r["_file"], r["_from"])):
        if r["_file"] != file:
            file, state = r["_file"], OUTSIDE
        out[r["_file"], r["_from"]] = state
        state = r["from_inside"] if state == INSIDE else r["from_outside"]
    return out


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, _file, _from, _at) of every record, headers included: its bytes, the range it begins in, its place there.

    Commas separate values, doubled quotes stand for one, line feeds end records; a quoted value that is never closed
    goes on to the end of its file. The table is written to the shared folder, since it is read several times.
    """
    ship_package(spark)
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"))
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("record"), *place)
    # one row a range (spark.sql.files.maxPartitionBytes of a file)
    functions = lines.mapInArrow(_functions, "_file string, _from bigint, from_outside int, from_inside int").collect()
    states = spark.sparkContext.broadcast(start_states(functions))
    cut = stage(lines.mapInArrow(_cut(states), PART), "records")
    # of each range at most the end of a record from before and the beginning of one that goes on
    parts = cut.where("begins IS NOT NULL")
    in_order = Window.partitionBy("_file").orderBy("_from", "begins")
    numbered = parts.withColumn("run", F.sum(F.col("begins").cast("int")).over(in_order))
    pieces = F.array_sort(F.collect_list(F.struct("_from", "begins", F.col("record").cast("string").alias("text"), "_at")))
    joined = numbered.groupBy("_file", "run").agg(pieces.alias("p")).select(
        F.array_join(F.transform("p", lambda x: x["text"]), "\n").cast("binary").alias("record"), "_file", F.col("p")[0]["_from"].alias("_from"), F.col("p")[0]["_at"].alias("_at")
    )
    return cut.where("begins IS NULL").drop("begins").unionByName(joined)
