"""A hashed maximum-entropy language model of words.

The probability of a word is that of its class given the history times that of the word in its class given the history.
A word's class follows from its last two bytes; the ``HEAD`` most frequent words of a class have slots of their own, all
others share one and are told apart by smoothed counts. Both factors are softmax models over hashed features of the
history: the word before, the two words before together, the words two and three places before (skips), and a bias. A
word of the history is itself where the training documents hold it ``LEAST`` times or more, else its class. The number of
such words follows the corpus, and so do the rows of the tables, up to ``WORDS`` and ``MAX_ROWS``: a model is broadcast,
and these are its proven bound.

Words beyond ``WORDS`` that come ``LEAST`` times or more are themselves, too, as the word before. Their weights are no part
of the broadcast: every token after such a word goes to the word's share of a Spark shuffle, with the odds that the model
gives it. There the word's weights are fitted to all of its training tokens and used for all tokens after it. Both softmax
models are taken as binary trees over their targets for that, so that five odds a token are enough and probabilities still
sum to one. None of these words has more than a ``WORDS``-th of all tokens, so no share is made of one word.

Training. The counts of all training words come from one Spark aggregation. The weights start from the class and head
frequencies. In a round every task runs gradient steps over its own documents, from the same weights; the changes of
each table row are then averaged over tasks, weighted by how often a task saw the row. A task hands on the rows that it
saw; they are summed in Spark by blocks of rows in a tree of ``FAN_IN`` tasks a node, so that no node grows with the
number of tasks, and the driver holds one model. Every training document takes part in one of the ``ROUNDS`` rounds.

Scoring. Documents are scored in numpy batches against the broadcast weights and the counts of the most frequent words (a
table of at most ``KNOWN`` entries). Words beyond it are joined with the full counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.llm.texts import _LOWER, as_texts, chunks, mix, words
from sheetlens.session import ship_package, stage

CLASSES = 32
HEAD = 31
SLOTS = HEAD + 1
OTHER = HEAD
LEAST = 32
WORDS = 1 << 16
MAX_ROWS = 1 << 16
#: words that may stand in a history: one for each class and slot, those before a text, and the frequent words
ATOMS = CLASSES * SLOTS + 1 + WORDS
NOTHING = CLASSES * SLOTS
CLASS_ROWS = 1 << 14
SLOT_ROWS = 1 << 15
BLOCK_ROWS = 1024
FAN_IN = 256
CLASS_FEATURES, SLOT_FEATURES = 5, 3
BATCH = 8192
RATE = 0.3
ROUNDS = 2
KNOWN = 1 << 20
SMOOTH = 0.1
#: levels of the binary tree over the targets of a softmax, log odds that are kept at most, steps and ridge of a word's fit
LEVELS, ODDS, STEPS, RIDGE = 5, 15.0, 3, 1.0
#: messages that a task holds before it hands them on, and tokens of the corpus for each share of the words
HELD, SHARE_TOKENS = 1 << 18, 1 << 22
#: numbers of the rows of a task
TASK_BITS = 40
END = np.uint64(0x5EED0000000000E5)

_U = np.uint64


def _is_training() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))


class Tokens:
    """Words and ends of some texts: text, hash and class of each token, in order."""

    def __init__(self, texts: pa.Array):
        found = words(texts)
        counts = found.counts()
        total = len(found.row) + len(counts)
        at = np.arange(len(found.row)) + found.row
        ends = np.cumsum(counts) + np.arange(len(counts))
        self.doc = np.repeat(np.arange(len(counts)), counts + 1)
        self.hash = np.full(total, END)
        self.hash[at] = found.hash
        last = _LOWER[found.data[found.end - 1]].astype(np.uint64)
        before = np.where(found.end - found.start > 1, _LOWER[found.data[np.maximum(found.end - 2, 0)]], 0).astype(np.uint64)
        self.cls = np.zeros(total, np.int64)
        self.cls[at] = (mix(last | before << _U(8)) % _U(CLASSES)).astype(np.int64)
        self.counts, self.ends = counts + 1, ends


class HashTable:
    """Numbers by 64-bit key, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.mask = _U((1 << self.bits) - 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int64)
        self.steps = 0
        left = np.arange(len(keys))
        while len(left):
            slot = ((keys[left] + _U(self.steps)) & self.mask).astype(np.int64)
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.values[slot[take]] = keys[left[take]], values[left[take]]
            left = np.delete(left, take)
            self.steps += 1

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        out = np.full(len(keys), missing, np.int64)
        left = np.arange(len(keys))
        for step in range(self.steps):
            slot = ((keys[left] + _U(step)) & self.mask).astype(np.int64)
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            left = left[~hit & (held != 0)]
            if not len(left):
                break
        return out


def features(tokens: Tokens, code: np.ndarray, sizes: tuple[int, int] = (CLASS_ROWS, SLOT_ROWS)) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the class table and of the slot table (of these sizes) active at each token, one array per feature.

    A code is a head word's slot, ``OTHER``, or more than that for a frequent word that is no head word.
    """
    atom = np.where(code > OTHER, NOTHING + code - OTHER, tokens.cls * SLOTS + code).astype(np.uint64)
    past = []
    for back in (1, 2, 3):
        before = np.full(len(atom), NOTHING, np.uint64)
        same = tokens.doc[back:] == tokens.doc[:-back]
        before[back:][same] = atom[:-back][same]
        past.append(before)
    a1, a2, a3 = past
    keys = [a1, a2 + _U(ATOMS), a3 + _U(2 * ATOMS), (a1 * _U(ATOMS) + a2) + _U(3 * ATOMS)]
    class_rows = [np.zeros(len(atom), np.int64)] + [1 + (mix(k) % _U(sizes[0] - 1)).astype(np.int64) for k in keys]
    own = tokens.cls.astype(np.uint64)
    slot_rows = [tokens.cls] + [CLASSES + (mix(k * _U(CLASSES) + own) % _U(sizes[1] - CLASSES)).astype(np.int64) for k in keys[:2]]
    return class_rows, slot_rows


_ONES = np.ones(SLOTS, np.float32)


def _exponentials(table: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, their exponentials) of all targets at each token; scores stay small, since steps and starts are."""
    z = np.take(table, rows[0], axis=0, mode="clip")
    part = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(table, r, axis=0, mode="clip", out=part)
    if z.max(initial=0) > 80:
        np.minimum(z, 80, out=z)
    return z, np.exp(z, out=part)


def log_probability(table: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Natural log of the softmax probability of ``target`` at each token."""
    return _log_softmax(*_exponentials(table, rows), target)


def _log_softmax(z: np.ndarray, e: np.ndarray, target: np.ndarray) -> np.ndarray:
    return z[np.arange(len(target)), target].astype(np.float64) - np.log((e @ _ONES).astype(np.float64))


def branch_odds(e: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Token x level: log odds of the branch towards ``target`` in the binary tree over all targets, from their exponentials."""
    out, each = np.empty((len(e), LEVELS), np.float16), np.arange(len(e))
    for level in range(LEVELS - 1, -1, -1):
        side = target >> (LEVELS - 1 - level)
        out[:, level] = np.clip(np.log(np.maximum(e[each, side], 1e-30) / np.maximum(e[each, side ^ 1], 1e-30)), -ODDS, ODDS)
        e = e[:, ::2] + e[:, 1::2]
    return out


def _descend(table: np.ndarray, power: np.ndarray, seen: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> None:
    """One gradient step on a batch, with a step size per row that falls with the gradients it has had."""
    _, gradient = _exponentials(table, rows)
    gradient /= (gradient @ _ONES)[:, None]
    gradient[np.arange(len(target)), target] -= 1
    for r in rows:
        if r[0] == r[-1] and (r == r[0]).all():  # the bias: one row for all tokens
            at, times, total = r[:1], len(r), (np.ones(len(r), np.float32) @ gradient)[None]
        else:
            # rows that fit 16 bits sort by counting
            order = np.argsort(r.astype(np.uint16) if len(table) <= 1 << 16 else r, kind="stable")
            r = r[order]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            at, times = r[first], np.diff(np.append(first, len(r)))
            total = _sums(gradient, order, first, times)
        power[at] += np.square(total).max(1)
        seen[at] += times
        total *= np.float32(RATE)
        total /= np.sqrt(power[at] + 1.0)[:, None]
        table[at] = np.subtract(np.take(table, at, axis=0, mode="clip"), total, out=total)


def _sums(gradient: np.ndarray, order: np.ndarray, first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of ``times`` gradients each, in ``order`` from ``first`` on; most are of one or two, and those are added all at once."""
    total = np.take(gradient, order[first], axis=0, mode="clip")
    two = np.flatnonzero(times == 2)
    total[two] += np.take(gradient, order[first[two] + 1], axis=0, mode="clip")
    more = np.flatnonzero(times > 2)
    if len(more):
        n = times[more]
        rows = order[np.repeat(times > 2, times)]
        total[more] = np.add.reduceat(np.take(gradient, rows, axis=0, mode="clip"), np.cumsum(n) - n, axis=0)
    return total


class Vocabulary:
    """Codes of the words: the slots of head words, then numbers of other frequent words."""

    def __init__(self, head: list, frequent: np.ndarray):
        slots = {r["hash"]: r["slot"] for r in head}
        others = np.array([h for h in frequent.tolist() if h not in slots], np.int64)
        keys = np.concatenate([np.array(list(slots), np.int64), others])
        codes = np.concatenate([np.array(list(slots.values()), np.int64), np.arange(len(others)) + OTHER + 1])
        self.codes = HashTable(keys.view(np.uint64), codes)

    def get(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(code, slot) of each token."""
        code = self.codes.get(tokens.hash, OTHER)
        return code, np.minimum(code, OTHER)


def _count(batches):
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def rows():
        known, kinds, times = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(known)
        known = known[order]
        first = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))
        total = np.add.reduceat(times[order], first)
        return pa.RecordBatch.from_arrays([pa.array(known[first].view(np.int64)), pa.array(kinds[order[first]].astype(np.int32)), pa.array(total)], ["hash", "cls", "n"])

    for batch in batches:
        for _, texts in chunks(as_texts(batch.column("text")), 8 << 20):
            tokens = Tokens(texts)
            new, first, n = np.unique(tokens.hash, return_index=True, return_counts=True)
            parts.append((new, tokens.cls[first], n))
            held += len(new)
            if held > 1 << 21:
                yield rows()
                parts, held = [], 0
    if parts:
        yield rows()


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, cls, n) of every token of ``docs``."""
    return docs.mapInArrow(_count, "hash bigint, cls int, n bigint").groupBy("hash").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))


def _train(model, vocabulary):
    def run(batches):
        start = model.value
        tables = [t.copy() for t in start]
        power = [np.zeros(len(t), np.float32) for t in tables]
        seen = [np.zeros(len(t), np.int64) for t in tables]
        for batch in batches:
            for _, texts in chunks(as_texts(batch.column("text"))):
                tokens = Tokens(texts)
                code, slot = vocabulary.value.get(tokens)
                class_rows, slot_rows = features(tokens, code, (len(tables[0]), len(tables[1])))
                for at in range(0, len(slot), BATCH):
                    part = slice(at, at + BATCH)
                    _descend(tables[0], power[0], seen[0], [r[part] for r in class_rows], tokens.cls[part])
                    _descend(tables[1], power[1], seen[1], [r[part] for r in slot_rows], slot[part])
        share = TaskContext.get().partitionId() // FAN_IN
        for number, (table, first, n) in enumerate(zip(tables, start, seen)):
            for at in range(0, len(table), BLOCK_ROWS):
                rows = np.flatnonzero(n[at : at + BLOCK_ROWS])
                if len(rows):
                    change = (table[at + rows] - first[at + rows]).astype(np.float16)
                    yield _piece(number, at, share, rows, n[at + rows], change)

    return run


CHANGES = "number int, at int, share int, rows binary, seen binary, change binary"
_NAMES = ["number", "at", "share", "rows", "seen", "change"]


def _piece(number: int, at: int, share: int, rows: np.ndarray, seen: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    whole = [pa.array([x], pa.int32()) for x in (number, at, share)]
    parts = [pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.int16), seen.astype(np.int64), change)]
    return pa.RecordBatch.from_arrays([*whole, *parts], _NAMES)


def _merge(pieces: pa.Table) -> pa.Table:
    """Mean change of the rows of a block over some tasks, weighted by how often each saw a row, and those numbers."""
    total, weight = None, np.zeros(BLOCK_ROWS, np.int64)
    for rows, seen, change in zip(*(pieces.column(c) for c in _NAMES[3:])):
        rows, seen = np.frombuffer(rows.as_py(), np.int16), np.frombuffer(seen.as_py(), np.int64)
        change = np.frombuffer(change.as_py(), np.float16).reshape(len(rows), -1).astype(np.float64)
        if total is None:
            total = np.zeros((BLOCK_ROWS, change.shape[1]))
        total[rows] += change * seen[:, None]
        weight[rows] += seen
    rows = np.flatnonzero(weight)
    number, at, share = (pieces.column(c)[0].as_py() for c in _NAMES[:3])
    mean = (total[rows] / weight[rows][:, None]).astype(np.float16)
    return pa.Table.from_batches([_piece(number, at, share // FAN_IN, rows, weight[rows], mean)])


def merged(changes: DataFrame, tasks: int) -> DataFrame:
    """One row per block: the changes of ``tasks`` tasks merged in a tree."""
    while True:
        changes = changes.groupBy("number", "at", "share").applyInArrow(_merge, CHANGES)
        if tasks <= FAN_IN:
            return changes
        tasks = -(-tasks // FAN_IN)


def table_sizes(words: int) -> tuple[int, int]:
    """Rows of the class table and of the slot table for this many words with codes."""
    rows = 1 << (4 * words).bit_length()
    return min(MAX_ROWS, max(CLASS_ROWS, rows)), min(MAX_ROWS, max(SLOT_ROWS, rows))


def start_weights(class_counts: np.ndarray, slot_counts: np.ndarray, sizes: tuple[int, int]) -> list[np.ndarray]:
    """Weights that give the frequencies of classes and slots whatever the history."""
    tables = [np.zeros((sizes[0], CLASSES), np.float32), np.zeros((sizes[1], SLOTS), np.float32)]
    tables[0][0] = np.log((class_counts + SMOOTH) / (class_counts + SMOOTH).sum())
    slot_counts = slot_counts + SMOOTH
    tables[1][:CLASSES] = np.log(slot_counts / slot_counts.sum(1, keepdims=True))
    return tables


MESSAGES = ["share", "word", "at", "cls", "slot", "odds"]
_DOCUMENT_TYPES = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.list_(pa.int64())] * 2
_MESSAGE_TYPES = [pa.int32()] + [pa.binary()] * 5
_KINDS = {"word": np.int64, "at": np.int64, "cls": np.uint8, "slot": np.uint8, "odds": np.float16}
_TRAINING = 128


class _Messages:
    """Tokens after words beyond the broadcast vocabulary, handed on by the share of their word."""

    def __init__(self, shares: int):
        self.shares, self.parts, self.held = shares, [], 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.held += len(part[0])

    def batches(self, least: int):
        """What is held, if it is ``least`` or more: a row for each share."""
        if self.held < least:
            return
        columns = [np.concatenate(x) for x in zip(*self.parts)]
        self.parts, self.held = [], 0
        share = (mix(columns[0].view(np.uint64)) % _U(self.shares)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        ends = np.cumsum(np.bincount(share, minlength=self.shares))
        parts = [np.split(c[order], ends[:-1]) for c in columns]
        some = np.flatnonzero(np.diff(ends, prepend=0))
        arrays = [pa.array([part[i].tobytes() for i in some], pa.binary()) for part in parts]
        yield some, arrays


def _gained(node: np.ndarray, right: np.ndarray, odds: np.ndarray, training: np.ndarray) -> np.ndarray:
    """Per token, what its natural log probability gains by a weight of its node; ``node`` is in order.

    The weights are fitted to the tokens that are ``training``, by Newton's steps of at most 1 from 0 with a ridge.
    """
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.append(first, len(node)))
    weight, side = np.zeros(len(first)), np.where(right, np.float32(1), np.float32(-1))
    own = np.zeros(len(node), np.float32)
    for _ in range(STEPS):
        other = training / (1 + np.exp(odds + own))
        slope = np.add.reduceat(side * other, first, dtype=np.float64) - RIDGE * weight
        other *= 1 - other
        weight += np.clip(slope / (np.add.reduceat(other, first, dtype=np.float64) + RIDGE), -1, 1)
        own = side * np.repeat(weight.astype(np.float32), size)
    return np.log1p(np.exp(-odds)) - np.log1p(np.exp(-odds - own))


def _learn(pieces: pa.Table) -> pa.Table:
    """What the log10 probabilities of the rows' tokens in a share of the words gain by the words' own weights, packed by the task that read the rows."""
    word, at, cls, slot, odds = (np.frombuffer(b"".join(x.as_buffer() for x in pieces.column(c)), kind) for c, kind in _KINDS.items())
    training, slot = slot >= _TRAINING, slot & (_TRAINING - 1)
    _, word = np.unique(word, return_inverse=True)
    # every occurrence of a word has one token after it
    often = np.bincount(word[training], minlength=word.max(initial=0) + 1) >= LEAST
    # from the top: the word, the tree of classes, the tree of slots in the class
    path = word << 2 * LEVELS | cls.astype(np.int64) << LEVELS | slot
    order = np.argsort(path, kind="stable")
    order = order[often[word[order]]]
    if not len(order):
        return pa.table({"task": pa.array([], pa.int64()), "row": pa.array([], pa.binary()), "more": pa.array([], pa.binary())})
    path, at, odds = path[order], at[order], odds.reshape(-1, 2 * LEVELS)[order]
    learning, more = training[order].astype(np.float32), np.zeros(len(order))
    for level in range(2 * LEVELS):
        left = 2 * LEVELS - level
        more += _gained(path >> left, (path >> left - 1 & 1).astype(bool), odds[:, level].astype(np.float32), learning)
    row, of = np.unique(at, return_inverse=True)
    more = np.bincount(of, more / np.log(10), len(row))
    task, first = np.unique(row >> TASK_BITS, return_index=True)
    packed = [pa.array([x.tobytes() for x in np.split(column, first[1:])], pa.binary()) for column in (row, more)]
    return pa.table([pa.array(task), *packed], ["task", "row", "more"])


def _add_up(pieces: pa.Table) -> pa.Table:
    """(row, more): the gains of a task's rows, added up over the shares of the words."""
    row, more = (np.frombuffer(b"".join(x.as_buffer() for x in pieces.column(c)), kind) for c, kind in (("row", np.int64), ("more", np.float64)))
    row, of = np.unique(row, return_inverse=True)
    return pa.table({"row": row, "more": np.bincount(of, more, len(row))})


def _score(model, vocabulary, known, totals, shares):
    """Rows of documents; if there are ``shares`` also rows of messages, without doc_id, in between."""
    documents = ["row", "doc_id", "n_tokens", "n_known", "base", "model", "rare", "times"]

    def run(batches):
        tables, (counts, least_known) = model.value, known.value
        n_all, v_all, other_n, other_v = totals.value
        log_z = np.log10(n_all + SMOOTH * (v_all + 1))
        log_other = np.log10(other_n + SMOOTH * (other_v + 1))
        row = TaskContext.get().partitionId() << TASK_BITS
        messages = _Messages(shares)

        def handed_on(least):
            for share, parts in messages.batches(least):
                none = [pa.nulls(len(share), kind) for kind in _DOCUMENT_TYPES]
                yield pa.RecordBatch.from_arrays([*none, pa.array(share, pa.int32()), *parts], [*documents, *MESSAGES])

        for batch in batches:
            for at, texts in chunks(as_texts(batch.column("text"))):
                tokens = Tokens(texts)
                n = len(texts)
                code, slot = vocabulary.value.get(tokens)
                class_rows, slot_rows = features(tokens, code, (len(tables[0]), len(tables[1])))
                count = counts.get(tokens.hash, -1)
                after = np.zeros(len(slot), bool)
                if shares:
                    often = (count >= LEAST) | ((count < 0) & (least_known > LEAST))
                    after[1:] = (code == OTHER)[:-1] & often[:-1] & (tokens.doc[1:] == tokens.doc[:-1])
                log_p, odds = np.empty(len(slot)), []
                for b in range(0, len(slot), BATCH):
                    part = slice(b, b + BATCH)
                    own = np.flatnonzero(after[part])
                    both = []
                    for number, (rows, target) in enumerate(((class_rows, tokens.cls[part]), (slot_rows, slot[part]))):
                        z, e = _exponentials(tables[number], [r[part] for r in rows])
                        both.append((_log_softmax(z, e, target), branch_odds(e[own], target[own])))
                    log_p[part] = both[0][0] + both[1][0]
                    odds.append(np.concatenate([both[0][1], both[1][1]], axis=1))
                if after.any():
                    i = np.flatnonzero(after)
                    training = batch.column("training").slice(at, n).to_numpy(zero_copy_only=False)[tokens.doc[i]]
                    kinds = tokens.cls[i].astype(np.uint8), (slot[i] + _TRAINING * training).astype(np.uint8)
                    messages.add(tokens.hash[i - 1].view(np.int64), row + tokens.doc[i], *kinds, np.concatenate(odds))
                    yield from handed_on(HELD)
                log_p /= np.log(10)
                log_c = np.where(count >= 0, np.log10(np.maximum(count, 0) + SMOOTH), 0.0)
                log_p += np.where(slot == OTHER, log_c - log_other[tokens.cls], 0.0)
                missing = np.flatnonzero(count < 0)
                # each rare word of a text once, with how often it comes; head words are never rare
                order = np.lexsort((tokens.hash[missing], tokens.doc[missing]))
                r, rare = tokens.doc[missing][order], tokens.hash[missing][order].view(np.int64)
                first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (rare[1:] != rare[:-1])])) if len(r) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(r)))
                r, rare = r[first], rare[first]
                bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]).astype(np.int32))

                def summed(x):
                    return pa.array(np.bincount(tokens.doc, weights=x, minlength=n))

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(at, n), pa.array(tokens.counts),
                        pa.array(np.bincount(tokens.doc, weights=count > 0, minlength=n).astype(np.int64)),
                        summed(log_c - log_z), summed(log_p),
                        pa.ListArray.from_arrays(bounds, pa.array(rare.astype(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int64))),
                        *(pa.nulls(n, kind) for kind in _MESSAGE_TYPES),
                    ],
                    [*documents, *MESSAGES],
                )
                row += n
        yield from handed_on(1)

    return run


SCORED = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, model double, rare array<bigint>, times array<bigint>, "
SCORED += "share int, word binary, at binary, cls binary, slot binary, odds binary"



def _most_frequent(counts: DataFrame, most: int, least: int = 0) -> pa.Table:
    """(hash, n) of the most frequent words: all with a count of at least ``least`` that at most ``most`` words reach."""
    sizes = counts.where(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("words"))
    above = Window.orderBy(F.col("n").desc())
    level = sizes.withColumn("sum", F.sum("words").over(above)).where(F.col("sum") <= most).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= (level if level is not None else 1 << 62)).select("hash", "n").orderBy(F.desc("n"), "hash").toArrow()


def _known_words(counts: DataFrame) -> tuple[HashTable, int]:
    """Counts of at most ``KNOWN`` most frequent words, and the least of them: all others are below."""
    rows = _most_frequent(counts, KNOWN)
    n = rows.column("n").to_numpy()
    return HashTable(rows.column("hash").to_numpy().view(np.uint64), n), int(n.min(initial=1 << 62))


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents learn and are scored as whole texts; a null text is an empty text, of which only the end counts. Documents
    without id take part in training. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = source.where(_is_training())
    counts = stage(count_words(training.select("text")), "counts")
    by_class = Window.partitionBy("cls").orderBy(F.col("n").desc(), "hash")
    head = counts.withColumn("slot", F.row_number().over(by_class) - 1).where(F.col("slot") < HEAD).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r["cls"]], class_v[r["cls"]] = r["n"], r["v"]
    slot_n = np.zeros((CLASSES, SLOTS))
    for r in head:
        slot_n[r["cls"], r["slot"]] = r["n"]
    slot_n[:, OTHER] = class_n - slot_n.sum(1)
    other_v = class_v - (slot_n[:, :OTHER] > 0).sum(1)
    frequent = _most_frequent(counts, WORDS, LEAST).column("hash").to_numpy()
    weights = start_weights(class_n, slot_n, table_sizes(len(frequent)))
    vocabulary = spark.sparkContext.broadcast(Vocabulary(head, frequent))
    tasks = training.rdd.getNumPartitions()
    turn = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(ROUNDS))
    for i in range(ROUNDS):
        model = spark.sparkContext.broadcast(weights)
        changes = training.where(F.coalesce(turn, F.lit(0)) == i).select("text").mapInArrow(_train(model, vocabulary), CHANGES)
        weights = [t.copy() for t in weights]
        for r in merged(changes, tasks).collect():
            rows = np.frombuffer(r["rows"], np.int16).astype(np.int64) + r["at"]
            weights[r["number"]][rows] += np.frombuffer(r["change"], np.float16).reshape(len(rows), -1)
        model.destroy()
    n_all, v_all = int(class_n.sum()), int(class_v.sum())
    model = spark.sparkContext.broadcast(weights)
    known = spark.sparkContext.broadcast(_known_words(counts))
    totals = spark.sparkContext.broadcast((n_all, v_all, slot_n[:, OTHER], other_v))
    # a model without rounds or words has learnt nothing of the words of a history
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_all // SHARE_TOKENS) if ROUNDS and WORDS else 0
    told = source.withColumn("training", _is_training())
    written = stage(told.mapInArrow(_score(model, vocabulary, known, totals, shares), SCORED), "scored")
    scored = written.where("share IS NULL").drop(*MESSAGES)
    learnt = written.where("share IS NOT NULL").select(*MESSAGES).groupBy("share").applyInArrow(_learn, "task bigint, row binary, more binary")
    learnt = learnt.groupBy("task").applyInArrow(_add_up, "row bigint, more double")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("hash"), F.col("w.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    met = rare.join(counts.select("hash", "n"), "hash", "left")
    met = met.select("row", (F.col("times") * F.log10(c + SMOOTH)).alias("late"), F.when(c > 0, F.col("times")).otherwise(0).alias("late_known"), F.lit(0.0).alias("more"))
    both = met.unionByName(learnt.select("row", F.lit(0.0).alias("late"), F.lit(0).cast("bigint").alias("late_known"), "more"))
    late = both.groupBy("row").agg(*[F.sum(k).alias(k) for k in ("late", "late_known", "more")])
    late_score = F.coalesce("late", F.lit(0.0))
    return scored.drop("rare", "times").join(late, "row", "left").select(
        "doc_id",
        (~_is_training()).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + late_score).alias("base_score"),
        (F.col("model") + late_score + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
