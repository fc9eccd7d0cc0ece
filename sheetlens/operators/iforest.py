"""Isolation forest (Liu, Ting and Zhou, ICDM 2008) over Spark rows.

All that is random comes from MD5 of (seed, row or tree, node) as integers, so that a forest is a function of its table that
any SQL engine can compute. Sampling, tree building and scoring are three Spark stages: hashes pick up to 256 rows per
tree in one scan, each tree is grown by ``applyInPandas`` from its own 256 rows, and the
forest (a few megabytes, whatever the table size) is broadcast to score Arrow batches.
A row's leaves are found without walking: per column, the number of thresholds below its value leads to the leaves that agree
with the value, and the leaf in all columns' sets is the row's (after Lucchese et al., QuickScorer, SIGIR 2015).
Splits are uniform in a column's range, so columns need no standardising. Path lengths are whole numbers of
``PATH_UNITS``, so their sums do not depend on the order of the trees.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.functions.quantiles import exact_quantiles
from sheetlens.functions.values import col, numeric_frame
from sheetlens.session import ship_package, spread, stage, unmeasured_rows
from sheetlens.sources.row_ids import ROW_ID, with_row_id

# Size of the forest and expected share of outliers.
TREES, SUBSAMPLE, CONTAMINATION, SEED = 200, 256, 0.05, 42
MIN_ROWS = 10

#: A level of a tree in path length units.
PATH_UNITS = 1_000_000_000
#: A tree's sample is drawn from rows whose hash is below a share that gives 6 standard deviations more than needed.
DRAWN = SUBSAMPLE + 106
WORD = 1 << 32

#: Trees whose tables are used together, and rows that go through them at once.
TOGETHER, AT_ONCE = 16, 2048
#: Leaves in a word of 64 bits, whose bit 0 stays free: a word without the row's leaf is 0.
LEAVES = 63
#: Multiplied by this, every power of two below 2**64 has upper six bits of its own (a de Bruijn sequence).
FACTOR, UPPER = np.uint64(0x022FDD63CC95386D), np.uint64(58)

TREE_DDL = "tree int, feature array<int>, threshold array<double>, path array<bigint>"


def mean_path(n: int) -> float:
    """Average depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def leaf_path(level: int, n: int) -> int:
    """Path length of a leaf with n rows, in units."""
    return level * PATH_UNITS + round(mean_path(n) * PATH_UNITS)


def node_numbers(tree: int, node: int) -> tuple[int, int]:
    """Two numbers below 2**32 that decide a node's column and threshold."""
    digest = hashlib.md5(f"{SEED}:split:{tree}:{node}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def grow(points: np.ndarray, depth: int, tree: int) -> tuple[list, list, list]:
    """One isolation tree laid out as a complete binary tree (children of i: 2i+1, 2i+2)."""
    inner = 2**depth - 1
    feature = np.zeros(inner, dtype=np.int32)
    threshold = np.full(inner, np.inf)
    path = np.zeros(2 * inner + 1, dtype=np.int64)
    todo = [(0, 0, np.arange(len(points)))]
    while todo:
        node, level, rows = todo.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if level == depth or len(rows) <= 1 or len(usable) == 0:
            # a leaf: points walk on to the left below it, so its length goes there too
            while node < inner:
                path[node] = leaf_path(level, len(rows))
                node = 2 * node + 1
            path[node] = leaf_path(level, len(rows))
            continue
        which, where = node_numbers(tree, node)
        f = usable[which % len(usable)]
        t = low[f] + (high[f] - low[f]) * (where / WORD)
        feature[node], threshold[node] = f, t
        right = points[rows, f] > t
        todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return feature.tolist(), threshold.tolist(), path.tolist()


def path_lengths(points: np.ndarray, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Depth at which one tree isolates each point."""
    at = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    for _ in range(int(math.log2(len(path) + 1)) - 1):
        at = 2 * at + 1 + (points[rows, feature[at]] > threshold[at])
    return path[at]


def splits_and_leaves(threshold: np.ndarray, path: np.ndarray) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Splits as (node, first leaf on the left, first on the right, end), and the path lengths of the leaves from left to right."""
    splits, leaves = [], []

    def walk(node: int):
        # no value is above an infinite or missing threshold: all rows go to the left
        while node < len(threshold) and not threshold[node] < np.inf:
            node = 2 * node + 1
        if node >= len(threshold):
            leaves.append(int(path[node]))
            return
        first = len(leaves)
        walk(2 * node + 1)
        middle = len(leaves)
        walk(2 * node + 2)
        splits.append((node, first, middle, len(leaves)))

    walk(0)
    return splits, leaves


def _bits(words: int, first: int, end: int) -> np.ndarray:
    """``words`` words with a bit for each of the leaves from ``first`` to ``end`` - 1."""
    out = np.zeros(words, np.uint64)
    at = np.arange(first, end)
    np.bitwise_or.at(out, at // LEAVES, np.uint64(1) << (at % LEAVES + 1).astype(np.uint64))
    return out


class LeafSets:
    """Some trees as tables: per column and place among its thresholds, the leaves that values there can reach."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int):
        read = [splits_and_leaves(threshold, path) for _, threshold, path in trees]
        starts = np.cumsum([0] + [-(-len(leaves) // LEAVES) for _, leaves in read])
        self.words = int(starts[-1])
        slots = ((np.uint64(1) << np.arange(1, LEAVES + 1, dtype=np.uint64)) * FACTOR >> UPPER).astype(int)
        paths, every = np.zeros((self.words, LEAVES + 1), np.int64), np.zeros(self.words, np.uint64)
        nodes: list[list[tuple[float, np.ndarray, np.ndarray]]] = [[] for _ in range(width)]
        for (feature, threshold, _), (splits, leaves), start, end in zip(trees, read, starts, starts[1:]):
            at = np.arange(len(leaves))
            paths[start + at // LEAVES, slots[at % LEAVES]] = leaves
            every[start:end] = _bits(end - start, 0, len(leaves))
            for node, first, middle, last in splits:
                left, right = np.zeros((2, self.words), np.uint64)
                left[start:end], right[start:end] = _bits(end - start, first, middle), _bits(end - start, middle, last)
                nodes[feature[node]].append((threshold[node], left, right))
        self.paths, self.begin = paths.ravel(), (LEAVES + 1) * np.arange(self.words, dtype=np.uint64)
        self.thresholds = [np.unique([t for t, _, _ in part]) for part in nodes]
        self.sets = []
        for part, thresholds in zip(nodes, self.thresholds):
            above, below = np.tile(every, (2, len(thresholds) + 1, 1))
            for t, left, right in part:
                place = np.searchsorted(thresholds, t)
                above[place + 1] &= ~left
                below[place] &= ~right
            self.sets.append(np.bitwise_and.accumulate(above) & np.bitwise_and.accumulate(below[::-1])[::-1])
        self.places: list[np.ndarray] = []


class Forest:
    """Summed path lengths of rows over all trees."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int):
        self.parts = [LeafSets(trees[i : i + TOGETHER], width) for i in range(0, len(trees), TOGETHER)]
        self.thresholds = [np.unique(np.concatenate([p.thresholds[c] for p in self.parts])) for c in range(width)]
        for part in self.parts:
            # the place among a part's thresholds follows from the place among all
            part.places = [np.searchsorted(own, np.append(every, np.inf)) for own, every in zip(part.thresholds, self.thresholds)]

    def __call__(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points), np.int64)
        for begin in range(0, len(points), AT_ONCE):
            x = points[begin : begin + AT_ONCE]
            places = [np.searchsorted(t, x[:, c]) for c, t in enumerate(self.thresholds)]
            for part in self.parts:
                one = None
                for place, own, sets in zip(places, part.places, part.sets):
                    found = np.take(sets, np.take(own, place), axis=0)
                    one = found if one is None else np.bitwise_and(one, found, out=one)
                # the only bit of a word becomes its slot in the table of path lengths
                one *= FACTOR
                one >>= UPPER
                one += part.begin
                total[begin : begin + AT_ONCE] += np.take(part.paths, one.view(np.int64)).sum(axis=1)
        return total


def _digest(*parts) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *parts).cast("binary"))


def _words(*parts) -> F.Column:
    """Four numbers below 2**32 from the MD5 of ``parts``."""
    digest = _digest(*parts)
    return F.transform(F.array(*(F.substring(digest, 1 + 8 * i, 8) for i in range(4))), lambda x: F.conv(x, 16, 10).cast("bigint"))


def draw_limits(n: int) -> tuple[int, int]:
    """Of n rows: the number that the hash of a row with any chance must be below, and that of a row in a given tree."""
    any_tree = min(WORD, TREES * DRAWN * WORD // n)
    return any_tree, min(WORD, DRAWN * WORD // n) if any_tree == WORD else WORD // TREES


def tree_samples(rows: DataFrame, n: int) -> DataFrame:
    """Up to 256 rows for each of the trees, as (tree, row id, values)."""
    want = min(SUBSAMPLE, n)
    any_tree, one_tree = draw_limits(n)
    # a row that no tree draws leaves before the trees are tried
    kept = rows
    if any_tree < WORD:
        # eight hexadecimal digits sort as their numbers do, which every row would have to be turned into
        kept = rows.where(F.substring(_digest(F.lit("any"), F.col(ROW_ID).cast("string")), 1, 8) < F.lit(f"{any_tree:08x}"))
    fours = F.transform(F.sequence(F.lit(0), F.lit(TREES // 4 - 1)), lambda q: _words(F.lit("tree"), F.col(ROW_ID).cast("string"), q.cast("string")))
    numbered = F.transform(F.flatten(fours), lambda h, i: F.struct(i.alias("tree"), h.alias("_hash")))
    drawn = kept.withColumn("_t", F.explode(F.filter(numbered, lambda t: t["_hash"] < F.lit(one_tree)))).select(*kept.columns, "_t.tree", "_t._hash")
    # one shuffle by tree serves the pick and the growing; the number keeps small data spread over the cores
    drawn = drawn.repartition(min(TREES, rows.sparkSession.sparkContext.defaultParallelism), "tree")
    pick = Window.partitionBy("tree").orderBy("_hash", ROW_ID)
    return drawn.withColumn("_pick", F.row_number().over(pick)).where(F.col("_pick") <= want).drop("_pick", "_hash")


def fit(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """One row per tree."""
    depth = max(1, math.ceil(math.log2(min(SUBSAMPLE, n))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW_ID)
        tree = int(pdf["tree"].iloc[0])
        grown = grow(pdf[columns].to_numpy(dtype=float), depth, tree)
        return pd.DataFrame([(tree, *grown)], columns=["tree", "feature", "threshold", "path"])

    return tree_samples(rows, n).groupBy("tree").applyInPandas(build, TREE_DDL)


def score(rows: DataFrame, forest: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Anomaly score in (0, 1) per row, with the column that holds its largest raw value."""
    spark = rows.sparkSession
    trees = [
        (np.array(t["feature"]), np.array(t["threshold"]), np.array(t["path"])) for t in forest.orderBy("tree").collect()
    ]
    model = spark.sparkContext.broadcast((Forest(trees, len(columns)), len(trees) * (mean_path(min(SUBSAMPLE, n)) * PATH_UNITS)))
    names = pa.array(columns)

    def apply(batches):
        lengths, scale = model.value
        for batch in batches:
            points = np.column_stack([batch.column(c).to_numpy() for c in columns]).astype(np.float64, copy=False)
            best = points.argmax(axis=1)
            parts = [
                batch.column(ROW_ID).cast(pa.int64()),
                pa.array(np.power(2.0, -(lengths(points) / scale))),
                names.take(pa.array(best)),
                pa.array(points[np.arange(len(points)), best]),
            ]
            yield pa.RecordBatch.from_arrays(parts, [ROW_ID, "score", "top_column", "top_value"])

    return rows.mapInArrow(apply, f"{ROW_ID} bigint, score double, top_column string, top_value double")


def isolation_forest(df: DataFrame, columns: list[str]) -> DataFrame | None:
    """Scored complete rows with ``is_outlier``; None when there are fewer than ten.

    The scored rows are written once, since both the threshold and the flags read them.
    """
    ship_package(df.sparkSession)
    rows = numeric_frame(with_row_id(df), columns, [ROW_ID]).na.drop(subset=columns)
    n = rows.count()
    if n < MIN_ROWS:
        return None
    rows = spread(rows, n, ROW_ID)
    with unmeasured_rows(df.sparkSession):
        scored = stage(score(rows, fit(rows, columns, n), columns, n), "forest")
    (cut,) = exact_quantiles(scored, ["score"], [1.0 - CONTAMINATION], {"score": n})["score"]
    return scored.withColumn("is_outlier", col("score") > F.lit(cut))


def summary(scored: DataFrame) -> DataFrame:
    """Number and share of flagged rows."""
    flags = F.count(F.when(F.col("is_outlier"), 1))
    return scored.agg(flags.alias("count"), F.round(F.try_divide(100.0 * flags, F.count("*")), 2).alias("pct_of_data"))
