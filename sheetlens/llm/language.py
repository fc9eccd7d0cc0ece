"""Language of spans of mixed-language text.

Words are runs of letters of one script; scripts without blanks between words give one word per letter. A word's
candidates are the languages whose training texts use its script; each candidate's score is a naive Bayes log
likelihood over the word's letters in context (letter with both neighbours, letter with the one before) and the whole
word. Viterbi over the words of a text, with a penalty for every switch, gives each word a language; consecutive words
of one language are a span. All tables are numpy arrays over code points, so that no Python object is made per word.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.texts import as_texts
from sheetlens.session import ship_package

#: Hashed features per kind (letter in context, letter pair, word): 3 * 4 * FEATURES bytes of the model per language.
FEATURES = 1 << 14
KINDS = 3
SMOOTHING = 0.5
#: Log-likelihood that a language must be better by, over a stretch of words, to be worth a switch there and one back.
SWITCH = 8.0
#: A word's score is at most this far below the best candidate's.
WORST = 12.0
#: Least share of a language's letters in a script that makes it a candidate for words of the script.
SCRIPT_SHARE = 0.01
#: Words of a run in the search for the best sequence of languages.
SEGMENT = 128
#: Code points worked on at once; a longer text is one piece.
PIECE = 1 << 18

# fixed values: first and last code point of the letters of common scripts, in the order of the code charts
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F),
    ("kana", 0x3040, 0x30FF), ("hangul", 0xAC00, 0xD7AF), ("hangul", 0x1100, 0x11FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x323AF),
)
UNSPACED = ("thai", "kana", "han")
NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))
UNSPACED_CODES = [NAMES.index(name) + 1 for name in UNSPACED]

_tables: list[np.ndarray] = []


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case (0 where it is no letter), and its script's number plus 1 (0: no letter)."""
    if not _tables:
        every = [chr(c) for c in range(sys.maxunicode + 1)]
        is_letter = np.fromiter((c.isalpha() for c in every), bool, len(every))
        lower = np.where(is_letter, np.arange(len(every)), 0).astype(np.uint32)
        for c in np.flatnonzero(is_letter):
            small = every[c].lower()
            if len(small) == 1:
                lower[c] = ord(small)
        script = is_letter.astype(np.uint8)
        for name, first, last in SCRIPTS:
            script[first : last + 1] *= NAMES.index(name) + 1
        _tables[:] = [lower, script]
    return _tables[0], _tables[1]


class Words(NamedTuple):
    """Words of some texts: row of the text, first and one past the last code point in it, script; letters and the features of all code points and words."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    features: list[np.ndarray]


def pieces(texts: pa.Array):
    """(first row, code points of all texts, bounds of each) of at most ``PIECE`` code points, or of one longer text."""
    held, at, size = [], 0, 0
    for i, text in enumerate(texts):
        points = np.frombuffer(text.as_py().encode("utf-32-le", "replace"), "<u4")
        if held and size + len(points) > PIECE:
            yield at, np.concatenate(held), np.cumsum([0, *map(len, held)])
            held, at, size = [], i, 0
        held.append(points)
        size += len(points)
    if held:
        yield at, np.concatenate(held), np.cumsum([0, *map(len, held)])


def _spread(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 32-bit values in place (a bijection; constants of a published integer hash)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def find_words(points: np.ndarray, bounds: np.ndarray) -> Words:
    """All words, with hashed features: every letter in context, every letter after the one before, every word."""
    lower, scripts = letter_tables()
    script = scripts[points]
    letter = lower[points]
    first = np.empty(len(points) + 1, bool)
    first[:1] = True
    first[1:-1] = script[1:] != script[:-1]
    for code in UNSPACED_CODES:
        first[:-1] |= script == code
    first[bounds] = True
    begins = np.flatnonzero(first)
    keep = script[begins[:-1]] > 0
    start, end = begins[:-1][keep], begins[1:][keep]
    inside = np.where(first[1:-1], np.uint32(0), np.uint32(0xFFFFFFFF))
    pair = letter * np.uint32(0x9E3779B1)
    pair[1:] += (letter[:-1] & inside) * np.uint32(0x85EBCA77)
    context = pair.copy()
    context[:-1] += (letter[1:] & inside) * np.uint32(0xC2B2AE3D)
    place = np.arange(len(points), dtype=np.uint32)
    place -= np.repeat(begins[:-1].astype(np.uint32), np.diff(begins))
    sums = np.zeros(len(points) + 1, np.uint32)
    np.cumsum(_spread(letter + place * np.uint32(0x27D4EB2F)), out=sums[1:], dtype=np.uint32)
    few = np.uint32(FEATURES - 1)
    features = [(_spread(x) & few).astype(np.intp) for x in (context, pair, sums[end] - sums[start])]
    row = np.searchsorted(bounds[1:], start, "right")
    return Words(row, start, end, script[start].astype(np.intp) - 1, letter != 0, features)


def _counts(learned: list[str]):
    number = {lang: i for i, lang in enumerate(learned)}

    def run(batches):
        n = len(learned)
        seen = np.zeros((KINDS, n * FEATURES), np.int64)
        scripts = np.zeros(n * len(NAMES), np.int64)
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for at, points, bounds in pieces(as_texts(batch.column("text"))):
                found = find_words(points, bounds)
                of_word = langs[at + found.row]
                of_letter = np.repeat(langs[at : at + len(bounds) - 1], np.diff(bounds))[found.letters] * FEATURES
                for kind in (0, 1):
                    seen[kind] += np.bincount(of_letter + found.features[kind][found.letters], minlength=n * FEATURES)
                seen[2] += np.bincount(of_word * FEATURES + found.features[2], minlength=n * FEATURES)
                scripts += np.bincount(of_word * len(NAMES) + found.script, weights=found.end - found.start, minlength=n * len(NAMES)).astype(np.int64)
        seen = seen.reshape(KINDS, n, FEATURES).transpose(1, 0, 2).reshape(n, KINDS * FEATURES)
        scripts = scripts.reshape(n, len(NAMES))
        for i in range(len(learned)):
            both = np.concatenate([seen[i], scripts[i]])
            slot = np.flatnonzero(both)
            if len(slot):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), i, np.int32)), pa.array(slot.astype(np.int32)), pa.array(both[slot])], ["lang", "slot", "n"])

    return run


class Model:
    """Learned languages in order, log probabilities by feature and language, candidates by script and language."""

    def __init__(self, learned: list[str], counts: np.ndarray):
        self.learned = learned
        seen, scripts = counts[:, : KINDS * FEATURES], counts[:, KINDS * FEATURES :]
        parts = seen.reshape(len(learned), KINDS, FEATURES) + SMOOTHING
        self.table = np.log(parts / parts.sum(2, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.candidates = (share >= SCRIPT_SHARE).T
        # where nothing tells languages apart, the one with most letters counts
        self.usual = int(np.argmax(scripts.sum(1))) if learned else 0


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame) -> Model:
    """Model from text and lang of all documents with an id that is not held out, whose lang is not null.

    What comes to the driver has ``KINDS * FEATURES`` counts a language, whatever the number of documents.
    """
    known = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    learned = sorted(r["lang"] for r in known.groupBy("lang").agg(F.lit(1)).collect())
    counts = np.zeros((len(learned), KINDS * FEATURES + len(NAMES)), np.int64)
    if learned:
        summed = known.select("text", "lang").mapInArrow(_counts(learned), "lang int, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
        counts[summed.column("lang").to_numpy(), summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    return Model(learned, counts)


def word_scores(model: Model, found: Words) -> np.ndarray:
    """(word, language): log likelihood below the best candidate's, at least -``WORST``; 0 for all without a candidate."""
    n = len(model.learned)
    out = np.zeros((len(found.start), n), np.float32)
    if not len(found.start):
        return out
    edges = np.stack([found.start, found.end], 1).ravel()
    if edges[-1] == len(found.letters):
        edges = edges[:-1]
    for i, (context, pair, word) in enumerate(model.table):
        letters = context[found.features[0]]
        letters += pair[found.features[1]]
        # the word itself counts as much as its letters do one by one
        out[:, i] = 0.5 * np.add.reduceat(letters, edges)[::2] + word[found.features[2]]
    allowed = model.candidates[found.script]
    none = ~allowed.any(1)
    out[~allowed] = -np.inf
    out[none] = 0
    out -= out.max(1, keepdims=True)
    return np.maximum(out, -WORST)


def _forward(score, first, length, start, penalty, back=None):
    """Best sums at the end of every run of words, from ``start`` (run, ..., language); fills ``back`` where it is given."""
    n = score.shape[1]
    own = np.arange(n, dtype=np.int16)
    now = start
    left = np.searchsorted(-length, -np.arange(length[0]), "left")  # runs with a word at each step
    for t in range(length[0]):
        k = left[t]
        at = first[:k] + t
        live = now[:k]
        best = live.max(-1, keepdims=True) - penalty
        if back is not None:
            back[at] = np.where(live >= best, own, live.argmax(-1)[:, None])
        step = np.maximum(live, best)
        step += score[at][:, None] if step.ndim == 3 else score[at]
        now[:k] = step
    return now, left


def viterbi(score: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """Language of every word: the sequence per text with the largest sum of scores less ``penalty`` a switch.

    Texts are cut into runs of ``SEGMENT`` words. For all runs together, word by word, the best sums from every
    language before the run to every language at its end are found; a pass over each text's runs gives what each starts
    with, and a second pass over the words the way back. So a step is a few array operations over all runs. Of equal sums
    the language of the word before stays, or the first in order is taken.
    """
    n_words, n = score.shape
    out = np.zeros(n_words, np.int64)
    if not n_words or n < 2:
        return out
    segment = SEGMENT if n <= 16 else n_words  # the sums from every language are n times the work
    text = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(text, n_words))
    runs = -(-size // segment)
    of = np.repeat(np.arange(len(text)), runs)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    first = text[of] + nth * segment
    length = np.minimum(size[of] - nth * segment, segment)
    order = np.argsort(-length, kind="stable")
    start = np.zeros((len(of), n))
    if (runs > 1).any():
        cut = order[runs[of[order]] > 1]
        # a language other than the one before the run costs a switch at its first word at the latest
        free = np.broadcast_to(np.where(np.eye(n, dtype=bool), 0.0, -1e300), (len(cut), n, n)).copy()
        gains = np.empty((len(of), n, n))
        gains[cut], _ = _forward(score, first[cut], length[cut], free, penalty)
        at = np.flatnonzero((nth == 0) & (runs[of] > 1))
        at = at[np.argsort(-runs[of[at]], kind="stable")]
        now = np.zeros((len(at), n))
        for t in range(runs.max()):
            k = int((runs[of[at]] > t).sum())
            start[at[:k] + t] = now[:k]
            now[:k] = (now[:k, :, None] + gains[at[:k] + t]).max(1)
            now[:k] -= now[:k].max(1, keepdims=True)
    back = np.empty((n_words, n), np.int16)
    end, left = _forward(score, first[order], length[order], start[order], penalty, back)
    last = np.empty((len(of), n))
    last[order] = end
    # way back over the runs of each text, then over the words of all runs: ``ways`` leads from a run's end to its start
    ways = np.broadcast_to(np.arange(n), (len(of), n)).copy()
    lead = first[order]
    for t in range(length.max() - 1, -1, -1):
        k = left[t]
        ways[:k] = np.take_along_axis(back[lead[:k] + t], ways[:k], 1)
    to_start = np.empty_like(ways)
    to_start[order] = ways
    state = np.zeros(len(of), np.int64)
    final = np.cumsum(runs) - 1
    state[final] = last[final].argmax(1)
    for t in range(1, runs.max()):
        at = final[runs > t] - t
        state[at] = to_start[at + 1, state[at + 1]]
    state = state[order]
    for t in range(length.max() - 1, -1, -1):
        k = left[t]
        at = lead[:k] + t
        out[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return out


def label_words(model: Model, points: np.ndarray, bounds: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, language number of each, its share of the likelihood among the languages)."""
    found = find_words(points, bounds)
    score = word_scores(model, found)
    label = viterbi(score, found.row, SWITCH)
    return found, label, score


SPANS = "array<struct<start: bigint, end: bigint, lang: string>>"


def _label(model):
    def run(batches):
        m = model.value
        for batch in batches:
            texts = as_texts(batch.column("text"))
            for at, points, bounds in pieces(texts):
                n = len(bounds) - 1
                ids = batch.column("doc_id").slice(at, n)
                if not m.learned:
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(_SPAN))], ["doc_id", "lang_pred", "score", "spans"]
                    )
                    continue
                found, label, score = label_words(m, points, bounds)
                k = len(m.learned)
                letters = (found.end - found.start).astype(float)
                mass = np.bincount(found.row * k + label, weights=letters, minlength=n * k).reshape(n, k)
                total = mass.sum(1)
                # of languages with as many letters the one that the words fit better, then the first
                fit_of = np.stack([np.bincount(found.row, weights=score[:, i], minlength=n) for i in range(k)], 1)
                best = np.lexsort((np.broadcast_to(-np.arange(k), (n, k)), fit_of, mass), axis=1)[:, -1]
                told = np.flatnonzero(total > 0)
                unknown = told[(fit_of[told].max(1) == fit_of[told].min(1)) & (k > 1)]
                best[unknown] = m.usual
                share = mass[np.arange(n), best] / np.maximum(total, 1)
                # the evidence for the language over all words against the next best one
                others = np.where(np.arange(k) == best[:, None], -np.inf, fit_of)
                ahead = fit_of[np.arange(n), best] - (others.max(1) if k > 1 else -WORST)
                sure = 1 / (1 + np.exp(-np.clip(ahead, -30, 30)))
                value = np.where(total > 0, share * sure, 0.0)
                value[unknown] = 1 / k
                lang = np.where(total > 0, np.array(m.learned, object)[best], "und")
                new = np.concatenate([[True], (found.row[1:] != found.row[:-1]) | (label[1:] != label[:-1])]) if len(label) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                close = np.append(begin[1:], len(label))[: len(begin)] - 1
                of = found.row[begin]
                per = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
                spans = pa.StructArray.from_arrays(
                    [pa.array(found.start[begin] - bounds[of]), pa.array(found.end[close] - bounds[of]), pa.array(np.array(m.learned, object)[label[begin]], pa.string())],
                    fields=list(_SPAN),
                )
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(lang, pa.string()), pa.array(np.clip(value, 0, 1)), pa.ListArray.from_arrays(pa.array(per), spans)], ["doc_id", "lang_pred", "score", "spans"]
                )

    return run


_SPAN = pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64()), pa.field("lang", pa.string())])


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), spans (start, end in code points, lang).

    The language of a text is the one with most letters in its spans; the score is its share of the letters, times how
    sure the words make it against the next best language. Texts that are null, empty or without a letter are ``und``
    with score 0 and no spans, as are all texts when no language was learned. Where no word tells the languages apart
    (letters of a script that no training text has), the language with most training letters is taken, with a score of
    one over the number of languages. Only the text enters a prediction. Rows without doc_id are labelled but never learned from; repeated
    rows are learned from each time. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(fit(docs))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = source.mapInArrow(_label(model), f"doc_id bigint, lang_pred string, score double, spans {SPANS}")
    return labelled.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
