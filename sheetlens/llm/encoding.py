"""Token ids of whole Arrow string columns by a public tokenizer file.

The library encodes each distinct piece of text once and numpy puts the ids together. Texts are only cut where the
tokenizer itself can never join what stands on both sides:

* ``drops_space`` (white space separates words and is dropped): at runs of ASCII white space, and A-Z count as a-z.
* otherwise (byte-level pieces with their leading blank): before a single blank between two characters that are not white
  space. White space beyond ASCII next to a blank is told by its first byte, and such a text stays uncut there.

Special tokens in a text are ordinary text. Every text ends with ``end_id``. The memo has a fixed number of entries.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from sheetlens.llm.texts import _SPACE, hash_spans, raw, words

SLOTS = 1 << 20
PROBES = 4
MEMO_IDS = 6 << 20

_encoders: dict[str, Encoder] = {}


def _spans(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts - at, counts)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            self.drops_space = json.load(file)["model"].get("end_of_word_suffix") is not None
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.length = np.zeros(SLOTS, np.int32)
        self.ids = np.zeros(MEMO_IDS, np.uint32)
        self.used = 0

    def _segments(self, texts: pa.Array):
        if self.drops_space:
            found = words(texts)
            return found.row, found.start, found.end, found.hash, found.data
        data, bounds = raw(texts)
        n = len(data)
        padded = np.zeros(n + 6, np.uint8)
        padded[3 : n + 3] = data
        b3, b2, b1, here, after = (padded[i : i + n] for i in range(5))
        cut = (here == 32) & ~_SPACE[b1] & ~_SPACE[after] & (b2 != 0xC2) & ~np.isin(b3, (0xE1, 0xE2, 0xE3)) & ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))
        filled = bounds[:-1][bounds[1:] > bounds[:-1]]
        edge = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        cut[edge] = False  # a last blank belongs to what stands before it
        cut[filled] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        return np.searchsorted(bounds[1:], start, "right"), start, end, hash_spans(data, start, end), data

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        out = np.where(self.keys[slot] == key, slot, -1)
        for step in range(1, PROBES):
            miss = np.flatnonzero(out < 0)
            if not len(miss):
                break
            other = (slot[miss] + step) & (SLOTS - 1)
            hit = self.keys[other] == key[miss]
            out[miss[hit]] = other[hit]
        return out

    def _keep(self, key: np.ndarray, at: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Remember new pieces while there is room near their slots; a full memo starts anew."""
        if self.used + len(ids) > MEMO_IDS:
            self.keys[:] = 0
            self.used = 0
            if len(ids) > MEMO_IDS:
                return
        self.ids[self.used : self.used + len(ids)] = ids
        left = np.arange(len(key))
        for step in range(PROBES):
            slot = ((key[left] & np.uint64(SLOTS - 1)).astype(np.int64) + step) & (SLOTS - 1)
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]] = key[left[take]]
            self.at[slot[take]] = self.used + at[left[take]]
            self.length[slot[take]] = length[left[take]]
            left = np.delete(left, take)
        self.used += len(ids)

    def encode(self, texts: pa.Array, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of each text)."""
        row, start, end, key, data = self._segments(texts)
        slot = self._find(key)
        at, length = self.at[slot], self.length[slot]
        source = self.ids
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, first, which = np.unique(key[missing], return_index=True, return_inverse=True)
            first = missing[first]
            whole = data.tobytes()
            pieces = [whole[s:e].decode("utf-8") for s, e in zip(start[first].tolist(), end[first].tolist())]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter((i for ids in lists for i in ids), np.uint32, int(sizes.sum()))
            first_id = np.cumsum(sizes) - sizes
            source = np.concatenate([self.ids[: self.used], ids])
            at = at.astype(np.int64)
            at[missing] = self.used + first_id[which]
            length = length.copy()
            length[missing] = sizes[which]
            self._keep(new, first_id, sizes, ids)
        sizes = np.bincount(row, weights=length, minlength=len(texts)).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(bounds[-1], end_id, np.uint32)
        inner = np.ones(bounds[-1], bool)
        inner[bounds[1:] - 1] = False
        out[inner] = source[_spans(at, length)]
        return out, bounds


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept for the life of a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
