"""Words and word shingles of Arrow string columns, as numpy arrays.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z count as
a-z. Words are told apart by 64-bit hashes, computed for a whole column at once: no Python object is made per word.
Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
#: For steps that hold many arrays per byte of text.
SMALL_CHUNK_BYTES = CHUNK_BYTES >> 2

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_EXACT_VALUE = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse mod 2**64; kept for one chunk, made anew for longer texts."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, CHUNK_BYTES + 1)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    tables = []
    for base in (_BASE, inverse):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    if size == CHUNK_BYTES + 1:
        _powers[:] = tables
    return tables[0][:n], tables[1][:n]


class Words(NamedTuple):
    """Words of some texts: row of the text, byte span in ``data``, hash of the lower-cased word."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    n_rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)


def as_texts(column) -> pa.Array:
    """One contiguous string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the bounds of each text."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of at most ``limit`` bytes each, or of one longer text."""
    _, bounds = raw(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


#: Bytes between words that are made of letters and digits only.
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(texts: pa.Array, between: np.ndarray = _SPACE) -> Words:
    """All words of ``texts`` in order; ``between`` says which bytes stand between words."""
    data, bounds = raw(texts)
    inside = ~between[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    before[edges] = False
    lasts = bounds[1:][bounds[1:] > 0] - 1
    after[lasts] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * power[:-1], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    row = np.searchsorted(bounds[1:], start, "right")
    return Words(row, start, end, hashes, data, len(texts))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans as they stand, upper case told from lower case."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_EXACT_VALUE[data] * power[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``n`` words; a text with fewer words gives all of them as one, none without words."""
    total = len(found.hash)
    counts = found.counts()
    factor = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    rows, hashes = [], []
    if total >= n:
        last = found.row[n - 1 :]
        whole = found.row[: total - n + 1] == last
        acc = found.hash[: total - n + 1] * factor[0]
        for j in range(1, n):
            acc = acc + found.hash[j : total - n + 1 + j] * factor[j]
        rows.append(last[whole])
        hashes.append(mix(acc[whole] + np.uint64(n)))
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(found.row, short)
        acc = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            have = counts[short] > j
            acc[have] += found.hash[first[have] + j] * factor[j]
        rows.append(short)
        hashes.append(mix(acc + counts[short].astype(np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


def distinct_per_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, in that order."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if not len(row):
        return row, value
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
    return row[first], value[first]


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array of consecutive pieces of ``values``."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def row_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Bounds of each row's entries in arrays ordered by row."""
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))])
