"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of hashed features: its lower-cased words, and the shapes of its words (runs of letters, capitals and
digits collapsed to one sign, other signs kept), and one of four forms by how often a word only repeats the one before. Bags are weighted by document frequencies over all documents,
projected on the leading singular directions of a labelled sample, and scaled to length one. The labelled vectors
(at most ``PER_LABEL`` per label, a set number of kilobytes) are broadcast; every document is compared with all of them
in blocks, exactly, and its ``NEIGHBOURS`` nearest vote with their similarity as weight. Since the sample holds as many
rows of a rare label as it can, votes are weighted back to the labels' shares among all labelled rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.texts import SMALL_CHUNK_BYTES, as_texts, chunks, hash_spans, words
from sheetlens.session import ship_package

FEATURES = 4096
SHAPES = 1024
FORMS = 4
#: Shares of words that repeat the word before, where one form ends and the next begins.
REPEATED = (0.05, 0.2, 0.5)
DIMENSIONS = 64
PER_LABEL = 3072
NEIGHBOURS = 25
POWER = 4
ACCEPT = 0.7
BLOCK_ROWS = 128

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) ordered by row and feature."""
    found = words(texts)
    if not len(found.row):
        return found.row, found.row, np.zeros(0)
    shape = _SHAPE[found.data]
    kept = np.ones(len(shape), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[found.start] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shapes = hash_spans(shape[kept], place[found.start], place[found.end])
    word = (found.hash % np.uint64(FEATURES - SHAPES)).astype(np.int64) + SHAPES
    again = np.bincount(found.row[1:][(found.hash[1:] == found.hash[:-1]) & (found.row[1:] == found.row[:-1])], minlength=len(texts))
    total = found.counts()
    filled = np.flatnonzero(total)
    form = np.searchsorted(REPEATED, again[filled] / total[filled], "right")
    feature = np.concatenate([(shapes % np.uint64(SHAPES - FORMS)).astype(np.int64) + FORMS, word, form])
    key = np.concatenate([found.row, found.row, filled]) * FEATURES + feature
    key, count = np.unique(key, return_counts=True)
    return key // FEATURES, key % FEATURES, count


def _weighted(row, feature, count, weight: np.ndarray, n: int) -> np.ndarray:
    """Feature weights scaled to length one per row, the three kinds of features apart."""
    value = (1 + np.log(count)) * weight[feature]
    kind = row * 3 + (feature >= FORMS) + (feature >= SHAPES)
    norm = np.sqrt(np.bincount(kind, weights=value * value, minlength=3 * n))
    return (value / np.maximum(norm[kind], 1e-12)).astype(np.float32)


def vectors(texts: pa.Array, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of length one; zero for texts without words."""
    out = np.zeros((len(texts), basis.shape[1]), np.float32)
    for at, part in chunks(texts, SMALL_CHUNK_BYTES):
        row, feature, count = bags(part)
        if not len(row):
            continue
        value = _weighted(row, feature, count, weight, len(part))
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[at + row[first]] = np.add.reduceat(basis[feature] * value[:, None], first, axis=0)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


class Bags:
    """Sparse rows of weighted features, multiplied in blocks of ``BLOCK_ROWS`` rows that are made full one at a time."""

    def __init__(self, row, feature, value, n: int):
        self.feature, self.value = feature, value
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        self.shape = (n, FEATURES)

    def _blocks(self):
        for at in range(0, self.shape[0], BLOCK_ROWS):
            to = min(at + BLOCK_ROWS, self.shape[0])
            held = slice(self.bounds[at], self.bounds[to])
            block = np.zeros((to - at, FEATURES), np.float32)
            block[np.repeat(np.arange(to - at), np.diff(self.bounds[at : to + 1])), self.feature[held]] = self.value[held]
            yield slice(at, to), block

    def times(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], q.shape[1]), np.float32)
        for rows, block in self._blocks():
            out[rows] = block @ q
        return out

    def squared_times(self, q: np.ndarray) -> np.ndarray:
        """The transpose times the rows times ``q``."""
        out = np.zeros_like(q)
        for _, block in self._blocks():
            out += block.T @ (block @ q)
        return out


def leading_directions(bag: Bags, k: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors by subspace iteration, as columns."""
    k = min(k, *bag.shape)
    q = np.random.default_rng(seed).standard_normal((bag.shape[1], k + 8)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(bag.squared_times(q))
    _, _, vt = np.linalg.svd(bag.times(q), full_matrices=False)
    return (q @ vt.T[:, :k]).astype(np.float32)


def votes(own: np.ndarray, known: np.ndarray, weight: np.ndarray, label: np.ndarray, prior: float) -> np.ndarray:
    """Share of label 1 among the nearest known vectors, weighted by similarity; ``prior`` without a similar one."""
    out = np.full(len(own), prior)
    k = min(NEIGHBOURS, len(known))
    if not k:
        return out
    for at in range(0, len(own), BLOCK_ROWS):
        near = own[at : at + BLOCK_ROWS] @ known.T
        top = np.argpartition(near, len(known) - k, axis=1)[:, len(known) - k :]
        similar = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** POWER
        mass = similar * weight[top]
        total = mass.sum(1)
        out[at : at + BLOCK_ROWS] = np.where(total > 1e-12, (mass * label[top]).sum(1) / np.maximum(total, 1e-12), prior)
    return np.clip(out, 0.0, 1.0)


def _frequencies(batches):
    seen = np.zeros(FEATURES, np.int64)
    n = 0
    for batch in batches:
        for _, part in chunks(as_texts(batch.column("text")), SMALL_CHUNK_BYTES):
            _, feature, _ = bags(part)
            seen += np.bincount(feature, minlength=FEATURES)
            n += len(part)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(FEATURES), -1)), pa.array(np.append(seen, n))], ["feature", "n"])


class Model:
    """What scoring needs; a few megabytes at most, whatever the number of documents."""

    def __init__(self, weight, basis, known, vote_weight, label, prior):
        self.weight, self.basis, self.known = weight, basis, known
        self.vote_weight, self.label, self.prior = vote_weight, label, prior


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the labelled rows that are not held out and the document frequencies of all documents.

    The sample is, per label, the ``PER_LABEL`` labelled documents that come first by a hash of their id. Rows without
    id, with a label other than 0 or 1, or without a document do not count; of repeated rows one counts.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    first = F.xxhash64(F.lit(11), "doc_id")
    picked = [known.where(F.col("quality") == q).orderBy(first, "doc_id").limit(PER_LABEL) for q in (0, 1)]
    sample_ids = picked[0].unionByName(picked[1])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * PER_LABEL ids
    rows = texts.join(F.broadcast(sample_ids), "doc_id").mapInArrow(_sample_bags, "doc_id bigint, quality int, key string, feature array<int>, count array<int>")
    # equal rows count once; what comes to the driver are arrays of at most 2 * PER_LABEL bags, not rows of Python numbers
    rows = rows.groupBy("doc_id", "key").agg(F.first("quality").alias("quality"), F.first("feature").alias("feature"), F.first("count").alias("count"))
    sample = rows.toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("key", "ascending")])
    counts = dict(texts.mapInArrow(_frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n")).collect())
    n = counts.get(-1, 0) or 0
    seen = np.array([counts.get(i, 0) or 0 for i in range(FEATURES)], float)
    weight = np.log((1.0 + n) / (1.0 + seen)) + 0.1
    row = np.repeat(np.arange(len(sample)), pc.list_value_length(sample.column("feature")).to_numpy())
    feature, count = (pc.list_flatten(sample.column(c)).to_numpy() for c in ("feature", "count"))
    bag = Bags(row, feature, _weighted(row, feature, count, weight, len(sample)), len(sample))
    label = sample.column("quality").to_numpy().astype(float)
    total = max(1, sum(shares.values()))
    prior = shares.get(1, 0) / total if shares else 0.5
    basis = leading_directions(bag, DIMENSIONS) if len(sample) else np.zeros((FEATURES, 1), np.float32)
    own = bag.times(basis)
    norm = np.sqrt((own * own).sum(1, keepdims=True))
    own = np.divide(own, norm, out=np.zeros_like(own), where=norm > 1e-9)
    per = {q: shares.get(q, 0) / max(1, (label == q).sum()) for q in (0, 1)}
    return Model(weight, basis, own, np.array([per[int(q)] for q in label]), label, prior)


def _sample_bags(batches):
    for batch in batches:
        for at, part in chunks(as_texts(batch.column("text")), SMALL_CHUNK_BYTES):
            row, feature, count = bags(part)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]).astype(np.int32)
            key = pa.array([hashlib.sha1(x.encode()).hexdigest() for x in part.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, len(part)), batch.column("quality").slice(at, len(part)), key,
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(count.astype(np.int32))),
                ],
                ["doc_id", "quality", "key", "feature", "count"],
            )


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            own = vectors(as_texts(batch.column("text")), m.weight, m.basis)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes(own, m.known, m.vote_weight, m.label, m.prior))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``ACCEPT`` on).

    Only texts enter a score. Null and empty texts get the share of label 1 among labelled rows, as do all documents
    when there are no labels at all (one half). Equal texts get equal scores. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = source.mapInArrow(_score(model), "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
