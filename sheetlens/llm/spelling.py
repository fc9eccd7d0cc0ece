"""Spelling variants among the words of all documents, found with pivotal bigrams.

Bigrams have one order over the whole vocabulary, rarest first. A word's gram prefix holds its 3 rarest bigrams (and
other places of the last of them): one edit destroys at most two neighbouring bigrams, so 3 always leave 2 disjoint ones.
Two disjoint bigrams of the prefix, chosen by dynamic programming for least cost, are the word's pivots. Of two words
one edit apart, take the one whose prefix ends earlier in the order: one of its pivots is untouched by the edit, and the
other word has it in its prefix. The edit is then on one side of that pivot, so all on the other side is the same and
the pivot's place, from that side, too. Entries are therefore keyed by the whole text up to the pivot (the edit comes
after it) and from the pivot on (the edit comes before it), which holds the limits on positions and cuts candidates to
words that share that side. Candidates are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.texts import as_texts
from sheetlens.session import drop_staged, ship_package, stage

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
#: One edit: Q * EDITS + 1 bigrams make a prefix, EDITS + 1 of them are pivots.
Q, EDITS = 2, 1
#: Longer words are met by halves.
LONG_WORD = 64
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Each form occurs ``RATIO`` times as often as its word, so no chain of forms is longer than a count has digits.
MAX_ROUNDS = 8

_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_LENGTH)


def thinned(doc_id: int, run: bytes, started: int) -> bytes:
    """The lower-cased run (Latin-1), without one code point where 31 divides its check sum. ``started``: crc32 of 'doc_id:'."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), started)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches):
    held: Counter = Counter()

    def out():
        words = [w.decode("latin-1") for w in held]
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        texts = as_texts(batch.column("text"))
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            # letters beyond Latin-1 become '?', which no run holds; bytes.lower() only changes A-Z
            runs = _RUN.findall(text.as_py().encode("latin-1", "replace").lower())
            if doc_id is None:
                held.update(runs)
            else:
                started = zlib.crc32(b"%d:" % doc_id)
                for run, n in Counter(runs).items():
                    word = thinned(doc_id, run, started)
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
            if len(held) > HELD_WORDS:
                yield out()
    yield out()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of at least ``MIN_LENGTH`` code points that occur ``MIN_COUNT`` times."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = source.mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _bigrams(batches):
    held: Counter = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            held.update(map(str.__add__, word, word[1:]))
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """bigram -> (place in the order, number of words' places that hold it). At most 90 letters squared, 8,100 entries."""
    counted = words.select("word").mapInArrow(_bigrams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    ranked = sorted(counted, key=lambda r: (r["n"], r["gram"]))
    return {r["gram"]: (i, r["n"]) for i, r in enumerate(ranked)}


def least_disjoint(places: list[int], costs: list[float], k: int, width: int) -> list[int]:
    """Indexes of ``k`` of the ascending ``places``, at least ``width`` apart, of the least summed cost."""
    # best[j][i]: least cost of j places among the first i, and the last one taken
    best = [[0.0] * (len(places) + 1)] + [[float("inf")] * (len(places) + 1) for _ in range(k)]
    taken = [[-1] * (len(places) + 1) for _ in range(k + 1)]
    free = [0] * len(places)
    for i, place in enumerate(places):
        free[i] = next((m for m in range(i, 0, -1) if places[m - 1] <= place - width), 0)
    for j in range(1, k + 1):
        for i in range(1, len(places) + 1):
            with_it = best[j - 1][free[i - 1]] + costs[i - 1]
            best[j][i], taken[j][i] = best[j][i - 1], taken[j][i - 1]
            if with_it < best[j][i]:
                best[j][i], taken[j][i] = with_it, i - 1
    picked, i = [], len(places)
    for j in range(k, 0, -1):
        at = taken[j][i]
        picked.append(at)
        i = free[at]
    return picked[::-1]


def prefix_and_pivots(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[int], list[int], int]:
    """Places of the bigrams of the gram prefix, places of the pivots among them, and where the prefix ends in the order."""
    ranks = [order[word[i : i + Q]][0] for i in range(len(word) - 1)]
    last = sorted(ranks)[min(Q * EDITS, len(ranks) - 1)]
    places = [i for i, r in enumerate(ranks) if r <= last]
    # an entry meets those that share its gram and one side: short sides cost most, a hundredth of it a letter more
    costs = [order[word[i : i + Q]][1] * (0.2**i + 0.2 ** (len(word) - Q - i)) for i in places]
    return places, [places[i] for i in least_disjoint(places, costs, EDITS + 1, Q)], last


def _letters(word: str) -> int:
    mask = 0
    for c in word:
        mask |= 1 << (ord(c) * 37 % 61)
    return mask


def _sides(word: str, order: dict[str, tuple[int, int]]):
    """(text that is the same in a near word, whether from a pivot, end of the prefix).

    A word beyond ``LONG_WORD`` may repeat a bigram at very many places; of it and a near word, the first half of the shorter
    one or the last is the same, so halves are its keys. Words of the two lengths at the bound have both kinds.
    """
    n = len(word)
    if n <= LONG_WORD + 1:
        places, chosen, last = prefix_and_pivots(word, order)
        for i in places:
            yield word[: i + Q] + "<", i in chosen, last
            yield ">" + word[i:], i in chosen, last
    if n >= LONG_WORD:
        for half in {n // 2, (n - 1) // 2}:
            yield word[:half] + "<", True, -1
            yield ">" + word[n - half :], True, -1


def _entries(order):
    def run(batches):
        grams = order.value
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for at in range(0, len(words), 20_000):
                row, key, pivot, end, mask = [], [], [], [], []
                for k, word in enumerate(words[at : at + 20_000]):
                    letters = _letters(word)
                    for side, is_pivot, last in _sides(word, grams):
                        row.append(at + k)
                        key.append(xxhash.xxh64_intdigest(side))
                        pivot.append(is_pivot)
                        end.append(last)
                        mask.append(letters)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(pivot, pa.bool_()), pa.array(end, pa.int32()), pa.array(mask, pa.int64()),
                        batch.column("word").take(pa.array(row, pa.int64())), pa.array([counts[i] for i in row], pa.int64()),
                    ],
                    ["key", "pivot", "end", "mask", "word", "n"],
                )

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of ``words`` exactly one edit apart, each once."""
    order = words.sparkSession.sparkContext.broadcast(gram_order(words))
    kind = "key bigint, pivot boolean, end int, mask bigint, word string, n bigint"
    entries = stage(words.mapInArrow(_entries(order), kind), "grams")
    a, b = entries.where("pivot").alias("a"), entries.alias("b")
    length = [F.char_length(f"{x}.word") for x in "ab"]
    meet = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.end") <= F.col("b.end"))
        & (F.abs(length[0] - length[1]) <= EDITS)
        & (F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask"))) <= 2 * EDITS)
        & (F.col("a.word") != F.col("b.word")) & (F.levenshtein("a.word", "b.word", EDITS) == EDITS)
    )
    # the smaller word first: a pair that both words find is one row
    found = a.join(b, meet).select(*(F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("word", "n")))
    one, two = F.struct(F.col("word_a").alias("word"), F.col("n_a").alias("n")), F.struct(F.col("word_b").alias("word"), F.col("n_b").alias("n"))
    once = found.select(F.least(one, two).alias("one"), F.greatest(one, two).alias("two")).distinct()
    both = F.array(F.struct(F.col("one").alias("x"), F.col("two").alias("y")), F.struct(F.col("two").alias("x"), F.col("one").alias("y")))
    return once.select(F.explode(both).alias("p")).select("p.x.word", "p.x.n", F.col("p.y.word").alias("near"), F.col("p.y.n").alias("near_n"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form), by pointer doubling: each round follows twice as many forms."""
    now = stage(links.select("word", F.col("form").alias("root")), "forms")
    for _ in range(MAX_ROUNDS):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        drop_staged(now)
        now = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return now
    raise RuntimeError(f"forms did not end in {MAX_ROUNDS} rounds")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Null and empty texts have no words. In rows without doc_id no letter is taken out, since that follows from the id;
    repeated rows count each time. Of near words with equal counts the smallest one is the form. Empty tables give no
    rows; other columns are not read. A word that holds a whole long text is a word like others.
    """
    ship_package(docs.sparkSession)
    words = stage(count_words(docs), "words")
    near = near_pairs(words)
    best = F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    near_n = -F.col("best.col1")
    counted = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    is_form = near_n >= RATIO * F.col("n")
    forms = stage(counted.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, near_n).alias("form_n")), "near")
    root = _roots(forms.where("form IS NOT NULL"))
    joined = words.join(forms, "word", "left").join(root, "word", "left")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
