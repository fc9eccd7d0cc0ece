"""Blocks of k-means as an RDD: every row once, sums as over the rows, and no more work than the leaves call for."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sheetlens import session
from sheetlens.operators import segment


def test_passes_over_kept_blocks(spark):
    random = np.random.default_rng(5)
    raw = random.normal(size=(3000, 2)) * [1.0, 40.0]
    hashes = [F.lpad(F.lower(F.hex((F.col("id") * f) % segment.PRIME)), 8, "0") for f in (48271, 69621)]
    values = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(raw)], "id bigint, a double, b double")
    rows = values.repartition(3).select("id", hashes[0].alias("h1"), hashes[1].alias("h9"), "a", "b")
    scale = segment.Scale(raw.mean(axis=0), raw.std(axis=0))
    blocks = segment.kept_blocks(rows, scale)
    keys, found = (np.concatenate(part) for part in zip(*segment._unpacked(2)(iter(blocks.collect()))))
    assert sorted(keys[:, 0]) == list(range(3000))
    assert (keys[:, 1] == keys[:, 0] * 48271 % segment.PRIME).all() and (keys[:, 2] == keys[:, 0] * 69621 % segment.PRIME).all()
    assert (found == raw[keys[:, 0]]).all()
    starts = segment.starting_centres(blocks, scale, 3, segment._unpacked(2))
    assert (starts == segment.starting_centres(rows, scale, 3)).all()
    models = {m: starts[m, :k] for m, k in enumerate((2, 3, 3))}
    blocks = segment.without_keys(blocks)
    sums = segment._summed(blocks, segment._assigned(scale, models, whole=True), models)
    x = scale(raw)
    for m, centres in models.items():
        away = ((x[:, None] - centres) ** 2).sum(axis=2)
        label = away.argmin(axis=1)
        for c in range(len(centres)):
            assert (sums[m][c, :, 0] == (label == c).sum()).all()
            assert np.allclose(sums[m][c, :, 1], x[label == c].sum(axis=0))
            assert np.allclose(sums[m][c, :, 2], (x[label == c] ** 2).sum(axis=0))
            assert np.allclose(sums[m][c, :, 3], away[label == c, c].sum())
    blocks.unpersist()


def test_rows_of_decided_leaves_are_left_alone():
    class Counting(segment.Scale):
        rows = 0

        def __call__(self, raw):
            Counting.rows += len(raw)
            return super().__call__(raw)

    random = np.random.default_rng(6)
    raw = np.concatenate([random.normal(size=(2048, 2)) - 50, random.normal(size=(2048, 2)) + 50])
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(4096, np.int64))] * 3 + [pa.array(c) for c in raw.T], ["id", "h1", "h9", "a", "b"])
    scale = Counting([0.0, 0.0], [1.0, 1.0])
    blocks = list(segment._blocks(scale)([batch]))
    Counting.rows = 0
    (sums,) = segment._assigned(scale, {0: np.array([[-50.0, -50.0], [50.0, 50.0]])})(iter(blocks))
    assert Counting.rows == 0
    assert sums.column("n").to_pylist() == [2048.0] * 4


def test_ordering_holds_rows_about_twice():
    rows, part = segment.ORDERED, 1 << 13
    random = np.random.default_rng(7)

    def batches():
        for begin in range(0, rows + 5, part):
            ids = np.arange(begin, min(begin + part, rows + 5))
            yield pa.RecordBatch.from_arrays([pa.array(ids)] * 3 + [pa.array(c) for c in random.normal(size=(6, len(ids)))], ["id", "h1", "h9", *"abcdef"])

    tracemalloc.start()
    sizes = [len(keys.as_py()) // 24 for block in segment._blocks(segment.Scale([0.0] * 6, [1.0] * 6))(batches()) for keys in block.column("keys")]
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(sizes) == rows + 5
    # keys and values of the rows, and the values once more: 9 + 6 numbers a row; before the rows were held three times and more
    assert most < 8 * 15 * rows * 1.6


def test_setting_for_rows_is_put_back(spark):
    before = spark.conf.get(session.BATCH_BYTES_KEY)
    with session.unmeasured_rows(spark), session.unmeasured_rows(spark):
        assert spark.conf.get(session.BATCH_BYTES_KEY) == session.UNMEASURED
    assert spark.conf.get(session.BATCH_BYTES_KEY) == before
