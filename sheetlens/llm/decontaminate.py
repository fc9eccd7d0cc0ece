"""Benchmark decontamination: a BM25 index of the test items, searched with every passage of every document.

Words are runs of letters and digits in lower case.

The index. An item's question and answer together are cut into entries of at most ``STRIDE`` words. An entry's score for
a passage is the BM25 sum over the terms they share, divided by the entry's score for itself, so one threshold serves
all items. Postings lie in blocks of ``BLOCK`` entries, with the largest weight of every term in every block.

The search. A passage is ``2 * STRIDE`` words, a new one begins every ``STRIDE`` words, so every entry that stands in a
text lies in one of them. As in block-max WAND, a passage is left when the largest weights of its terms cannot reach the
threshold together, then a block of entries is left when its block maxima cannot, and only postings in the other blocks
are read and scored. Nothing above the threshold is lost; there is no top-k.

The check. A retrieved item counts when at least ``QUESTION`` of its question's word n-grams and ``ANSWER`` of its answer's
stand in the document. The index is broadcast in shards of at most ``SHARD_ENTRIES`` entries, one after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.llm.texts import NOT_ALPHANUMERIC, Words, as_texts, chunks, shingles, words
from sheetlens.session import ship_package, stage

STRIDE = 64
BLOCK = 16
SHARD_ENTRIES = 2048
K1, B = 1.2, 0.75
THRESHOLD = 0.5
NGRAM = 5
QUESTION = ANSWER = 0.5

LEAKS = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
_FILTER_BITS = 16
_SLACK = 1e-5  # sums of maxima are in single precision


def question_and_answer(items: DataFrame, share: float = 0.25) -> DataFrame:
    """(item_id, question, answer) of items with one ``text``: the last ``share`` of the words, one at least, is the answer."""
    found = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words")
    tail = F.greatest(F.lit(1), F.ceil(n * F.lit(share))).cast("int")
    return (
        items.select(F.col("item_id").cast("bigint").alias("item_id"), found.alias("words"))
        .where(n > 0)
        .select(
            "item_id",
            F.array_join(F.expr(f"slice(words, 1, size(words) - greatest(1, int(ceil(size(words) * {share}))))"), " ").alias("question"),
            F.array_join(F.slice("words", n - tail + 1, tail), " ").alias("answer"),
        )
    )


def plain_words(texts: pa.Array) -> Words:
    """Words of letters and digits in lower case (of any script), so that marks and capitals hide no item."""
    return words(pc.utf8_lower(texts), NOT_ALPHANUMERIC)


def _entries(batches):
    names = ["item_id", "part", "term", "tf", "n"]
    for batch in batches:
        both = pa.array([f"{q or ''} {a or ''}" for q, a in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist())], pa.string())
        found = plain_words(both)
        first = np.searchsorted(found.row, np.arange(found.n_rows))
        part = (np.arange(len(found.row)) - first[found.row]) // STRIDE
        key = np.stack([found.row, part, found.hash.view(np.int64)], 1)
        keys, tf = np.unique(key, axis=0, return_counts=True)
        sizes = {}
        for r, p in zip(found.row.tolist(), part.tolist()):
            sizes[r, p] = sizes.get((r, p), 0) + 1
        n = np.array([sizes[r, p] for r, p in keys[:, :2].tolist()], np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id").take(pa.array(keys[:, 0])), pa.array(keys[:, 1].astype(np.int32)), pa.array(keys[:, 2]), pa.array(tf), pa.array(n)], names
        )


def build_postings(items: DataFrame) -> DataFrame:
    """(shard, entry, item_id, term, weight): normalised BM25 weights; statistics cover all entries."""
    rows = items.mapInArrow(_entries, "item_id bigint, part int, term bigint, tf bigint, n bigint")
    rows = stage(rows.groupBy("item_id", "part", "term").agg(F.max("tf").alias("tf"), F.max("n").alias("n")), "terms")
    sizes = rows.groupBy("item_id", "part").agg(F.max("n").alias("n"))
    total, mean = sizes.agg(F.count("*"), F.avg("n")).first()
    idf = rows.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log1p((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    norm = K1 * (1 - B + B * F.col("n") / F.lit(mean or 1.0))
    weighted = rows.join(idf, "term").withColumn("w", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    own = weighted.groupBy("item_id", "part").agg(F.sum("w").alias("own"))
    # entries of like length share blocks, so that block maxima stay close to what an entry can score
    shards = max(1, -(-total // SHARD_ENTRIES))
    shard = F.pmod(F.xxhash64("item_id", "part"), F.lit(shards)).cast("int")
    place = Window.partitionBy("shard").orderBy("n", "item_id", "part")
    entries = sizes.withColumn("shard", shard).withColumn("entry", F.row_number().over(place) - 1)
    return stage(
        weighted.join(own, ["item_id", "part"])
        .join(entries.select("item_id", "part", "shard", "entry"), ["item_id", "part"])
        .select("shard", "entry", "item_id", "term", (F.col("w") / F.col("own")).alias("weight")),
        "postings",
    )


class Shard:
    """Part of the index in arrays, with the n-grams that the check needs."""

    def __init__(self, postings: list, items: list):
        rows = sorted((r["term"], r["entry"], r["weight"], r["item_id"]) for r in postings)
        term = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        self.terms, number = np.unique(term, return_inverse=True)
        self.entry = np.array([r[1] for r in rows], np.int64)
        order = np.lexsort((self.entry, number))
        number, self.entry = number[order], self.entry[order]
        self.weight = np.array([r[2] for r in rows])[order]
        n = int(self.entry.max()) + 1 if len(rows) else 0
        self.item = np.zeros(n, np.int64)
        self.item[self.entry] = np.array([r[3] for r in rows], np.int64)[order]
        self.blocks = -(-n // BLOCK)
        block = self.entry // BLOCK
        # first posting of each term in each block
        self.at = np.searchsorted(number * (self.blocks + 1) + block, np.arange(len(self.terms) * (self.blocks + 1) + 1)).astype(np.int32)
        self.maxima = np.zeros((len(self.terms), self.blocks), np.float32)
        np.maximum.at(self.maxima, (number, block), self.weight.astype(np.float32))
        self.largest = self.maxima.max(1) if n else np.zeros(0, np.float32)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.terms & np.uint64((1 << _FILTER_BITS) - 1)] = True
        self.check: dict[int, list[tuple[int, np.ndarray, int, np.ndarray]]] = {}
        for r in items:
            self.check.setdefault(r["item_id"], []).append((*_grams(r["question"], NGRAM), *_grams(r["answer"], 3)))

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes``, term numbers) of the words that the shard knows."""
        place = np.flatnonzero(self.maybe[hashes & np.uint64((1 << _FILTER_BITS) - 1)])
        number = np.searchsorted(self.terms, hashes[place])
        hit = self.terms[np.minimum(number, len(self.terms) - 1)] == hashes[place]
        return place[hit], number[hit]


def _grams(text: str | None, n: int) -> tuple[int, np.ndarray]:
    """(n, distinct n-grams) of a question or an answer; short ones take shorter n-grams."""
    found = plain_words(pa.array([text or ""], pa.string()))
    n = max(1, min(n, len(found.row) // 2))
    return n, np.unique(shingles(found, n)[1])


def _expand(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - at, counts)


def retrieve(found, shard: Shard, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, entry, score) of all passages and entries that reach the threshold."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    counts = found.counts()
    halves = (counts + STRIDE - 1) // STRIDE  # pieces of STRIDE words; passage j of a text is its pieces j and j + 1
    base = np.cumsum(halves) - halves
    place, term = shard.lookup(found.hash)
    if not len(place):
        return none
    first = np.cumsum(counts) - counts
    row = found.row[place]
    piece = base[row] + (place - first[row]) // STRIDE
    n_pieces = int(halves.sum())
    owner = np.repeat(np.arange(len(halves)), halves)
    has_next = np.append(owner[1:] == owner[:-1], False)

    def passages(per_piece: np.ndarray) -> np.ndarray:
        after = np.zeros_like(per_piece)
        after[:-1] = per_piece[1:]
        after[~has_next] = 0
        return per_piece + after

    alive = passages(np.bincount(piece, weights=shard.largest[term], minlength=n_pieces)) >= threshold - _SLACK
    if not alive.any():
        return none
    # block maxima of the pieces that a living passage needs
    needed = alive.copy()
    needed[1:] |= alive[:-1] & has_next[:-1]
    keep = needed[piece]
    piece, term = piece[keep], term[keep]
    sums = np.zeros((n_pieces, shard.blocks), np.float32)
    begin = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    sums[piece[begin]] = np.add.reduceat(shard.maxima[term], begin, axis=0)
    passage, block = np.nonzero((passages(sums) >= threshold - _SLACK) & alive[:, None])
    if not len(passage):
        return none
    # distinct terms of each living passage, then their postings in its living blocks
    lives = np.unique(passage)
    key = np.concatenate([piece, piece[piece > 0] - 1]) * len(shard.terms) + np.concatenate([term, term[piece > 0]])
    of = key // len(shard.terms)
    back = np.concatenate([np.zeros(len(piece), bool), np.ones(len(of) - len(piece), bool)])
    key = np.unique(key[np.isin(of, lives) & (~back | has_next[of])])
    of, term = key // len(shard.terms), key % len(shard.terms)
    low, high = np.searchsorted(of, passage), np.searchsorted(of, passage, "right")
    pair = np.repeat(np.arange(len(passage)), high - low)
    t = term[_expand(low, high - low)]
    cell = t * (shard.blocks + 1) + block[pair]
    spans = shard.at[cell], shard.at[cell + 1] - shard.at[cell]
    posting = _expand(*spans)
    pair = np.repeat(pair, spans[1])
    score = np.bincount(pair * BLOCK + shard.entry[posting] % BLOCK, weights=shard.weight[posting], minlength=len(passage) * BLOCK)
    over = np.flatnonzero(score >= threshold)
    return owner[passage[over // BLOCK]], block[over // BLOCK] * BLOCK + over % BLOCK, score[over]


def _search(index, threshold: float):
    def run(batches):
        shard = index.value
        for batch in batches:
            for at, texts in chunks(as_texts(batch.column("text"))):
                found = plain_words(texts)
                row, entry, score = retrieve(found, shard, threshold)
                best: dict[tuple[int, int], float] = {}
                for r, i, s in zip(row.tolist(), shard.item[entry].tolist(), score.tolist()):
                    best[r, i] = max(best.get((r, i), 0.0), s)
                out, grams = [], {}
                for (r, i), s in sorted(best.items()):
                    for nq, question, na, answer in shard.check[i]:
                        shares = []
                        for n, wanted in ((nq, question), (na, answer)):
                            if (r, n) not in grams:
                                a, b = np.searchsorted(found.row, r), np.searchsorted(found.row, r, "right")
                                one = found._replace(row=np.zeros(b - a, np.int64), hash=found.hash[a:b], n_rows=1)
                                grams[r, n] = shingles(one, n)[1] if b - a >= n else np.zeros(0, np.uint64)
                            shares.append(float(np.isin(wanted, grams[r, n]).mean()) if len(wanted) else 1.0)
                        if shares[0] >= QUESTION and shares[1] >= ANSWER:
                            out.append((r, i, s, *shares))
                if out:
                    r, *rest = zip(*out)
                    ids = batch.column("doc_id").slice(at, len(texts)).take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, rest)], [f.split()[0] for f in LEAKS.split(", ")])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document that holds a test item.

    ``items`` has item_id, question and answer. Items without words and rows without item_id are not looked for; null and
    empty texts hold none; rows that repeat a doc_id or an item_id count as one, with the larger figures. Other columns
    are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    wanted = stage(
        items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
        .where(F.col("item_id").isNotNull())
        .distinct(),
        "items",
    )
    postings = build_postings(wanted)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], LEAKS)
    for (shard,) in sorted(postings.select("shard").distinct().collect()):
        rows = postings.where(F.col("shard") == shard)
        held = wanted.join(rows.select("item_id").distinct(), "item_id").collect()
        index = spark.sparkContext.broadcast(Shard(rows.collect(), held))
        found = found.unionByName(source.mapInArrow(_search(index, threshold), LEAKS))
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))
