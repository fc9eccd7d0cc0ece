"""K-means segments with the number of clusters chosen by silhouette.

All numbers of clusters and all starts go through Lloyd's steps together: a pass assigns every row in every model, tasks add up
their blocks of rows per centre and Spark adds those. Starts are k-means++ picks by hashes of row ids, so a lost task gives the
same rows again and SQL can compute the same models.

A block holds rows in the order of a k-d tree, whose leaves know their box and sums. Where a box lies on one centre's side of
all planes between a model's centres, the leaf's sums go to that centre at once (Kanungo et al., TPAMI 2002); rows of other leaves
are compared one by one, so that every row has the cluster it would have without the tree.

Blocks are kept as an RDD of Arrow batches: a pass reads each as it was pickled, where a cached table would be made into rows
and batches again.
"""

from __future__ import annotations

import binascii
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.functions.values import col, numeric_frame
from sheetlens.session import ship_package, spread, unmeasured_rows
from sheetlens.sources.row_ids import ROW_ID, with_row_id

# Limits, seed, starts, when to stop, and segment names.
MIN_COLUMNS, MIN_ROWS = 2, 15
SEED, STARTS, STEPS, TOLERANCE, ALIKE = 42, 10, 300, 1e-4, 1.000000001
HIGH, MIDDLE, BASE = "High Activity Segment", "Growth Potential Segment", "Baseline / Moderate Segment"
TOO_FEW_COLUMNS = (
    "Clustering was skipped because this dataset does not contain enough numerical features (minimum 2 required)."
)
TOO_FEW_ROWS = (
    "Clustering was skipped because the dataset has too few records for meaningful segmentation (minimum 15 required)."
)
ALL_ALIKE = "Clustering encountered an error: all records are alike."
INFINITE = "Clustering encountered an error: a column holds infinite values."
#: Hashes of rows are mixed for every pick by a linear function modulo this prime.
PRIME = 2**31 - 1
#: Rows of a leaf, rows that a task puts in order at once, and rows of a block.
LEAF, ORDERED, BLOCK = 32, 2**19, 2**16
#: Rows that bound the shortest waiting time before the others are looked at.
TRIED = 1024
#: Share of the numbers compared that rounding stays below.
ROUNDING = 1e-12


def candidate_ks(n: int) -> list[int]:
    return list(range(2, max(3, min(5, n // 10))))


def not_applicable(columns: list[str], n: int) -> str | None:
    """Why a table cannot be segmented, or None."""
    if len(columns) < MIN_COLUMNS:
        return TOO_FEW_COLUMNS
    return TOO_FEW_ROWS if n < MIN_ROWS else None


def _mixer(start: int, place: int) -> list[int]:
    """Factors and summands for the two hashes of a row, for one pick of one start."""
    digest = hashlib.md5(f"{SEED}:seed:{start}:{place}".encode()).hexdigest()
    w = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    return [1 + w[0] % (PRIME - 1), w[1] % PRIME, 1 + w[2] % (PRIME - 1), w[3] % PRIME]


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, summed column by column: no row is nearer than 0."""
    out = np.zeros((len(x), len(centres)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - centres[None, :, i]) ** 2
    return out


class Scale:
    """Standardises raw values."""

    def __init__(self, mean: list[float], std: list[float]):
        self.mean, self.std = np.array(mean), np.array(std)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return (raw - self.mean) / self.std


def _numbers(column: pa.Array) -> np.ndarray:
    """Values of a column; those of text are eight lower-case hexadecimal digits each."""
    if not pa.types.is_string(column.type):
        return column.to_numpy()
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    digits = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, 8)
    digits = (digits & 15) + 9 * (digits >> 6)
    return (digits[:, ::2] * 16 + digits[:, 1::2]).view(">u4").ravel().astype(np.int64)


def _matrices(batches):
    """(keys, raw values) of batches of rows: row id, two hashes, columns."""
    for batch in batches:
        if batch.num_rows:
            keys, raw = (np.column_stack([_numbers(c) for c in part]) for part in (batch.columns[:3], batch.columns[3:]))
            yield keys.astype(np.int64, copy=False), raw.astype(np.float64, copy=False)


_BLOCK = ["keys", "raw", "leaves"]


def _tree_order(columns: np.ndarray) -> np.ndarray:
    """Order of the rows by halving on the widest column, down to leaves; their number is a leaf's times a power of two.

    ``columns`` (column x row) are put in that order on the way, one column at a time.
    """
    order, cells = np.arange(columns.shape[1]), 1
    while len(order) // cells > LEAF:
        cut = columns.reshape(len(columns), cells, -1)
        widest = (cut.max(axis=2) - cut.min(axis=2)).argmax(axis=0)
        size = cut.shape[2]
        at = np.argpartition(cut[widest, np.arange(cells)], size // 2, axis=1)
        at += size * np.arange(cells)[:, None]
        at = at.ravel()
        order, cells = order[at], 2 * cells
        for column in columns:
            column[:] = column[at]
    return order


def _blocks(scale: Scale):
    """Rows as blocks in the order of their trees; the last few rows of a task are a block without leaves.

    A task holds ``ORDERED`` rows once as they came and once standardised, while it puts them in order.
    """

    def standardised(raw):
        columns = np.empty(raw.shape[::-1])
        for begin in range(0, len(raw), BLOCK):
            columns[:, begin : begin + BLOCK] = scale(raw[begin : begin + BLOCK]).T
        return columns

    def ordered(keys, raw):
        while len(raw):
            n = LEAF << ((len(raw) // LEAF).bit_length() - 1) if len(raw) >= LEAF else len(raw)
            order = _tree_order(standardised(raw[:n])) if n >= LEAF else np.arange(n)
            for begin in range(0, n, BLOCK):
                rows = order[begin : begin + BLOCK]
                cells = scale(raw[rows][: len(rows) // LEAF * LEAF]).reshape(-1, LEAF, raw.shape[1])
                low, high = cells.min(axis=1), cells.max(axis=1)
                leaves = np.stack([(low + high) / 2, (high - low) / 2, cells.sum(axis=1), (cells**2).sum(axis=1)])
                parts = [keys[rows], raw[rows], leaves]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], _BLOCK)
            keys, raw = keys[n:], raw[n:]

    def run(batches):
        keys = raw = None
        count = 0
        for new_keys, new_raw in _matrices(batches):
            if raw is None:
                # pages are taken as rows come
                keys, raw = np.empty((ORDERED, 3), np.int64), np.empty((ORDERED, new_raw.shape[1]))
            while len(new_raw):
                n = min(ORDERED - count, len(new_raw))
                keys[count : count + n], raw[count : count + n] = new_keys[:n], new_raw[:n]
                new_keys, new_raw, count = new_keys[n:], new_raw[n:], count + n
                if count == ORDERED:
                    yield from ordered(keys, raw)
                    count = 0
        if count:
            yield from ordered(keys[:count], raw[:count])

    return run


def kept_blocks(rows: DataFrame, scale: Scale) -> RDD:
    """Blocks of ``rows`` (row id, two hashes, columns) that every pass reads; cached, and recomputed if an executor goes."""
    ordered = _blocks(scale)

    def run(batches):
        # the way from a table to an RDD takes bytes one by one, but text as a whole
        for block in ordered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([binascii.b2a_base64(c[0].as_buffer(), newline=False)], pa.binary()).cast(pa.string()) for c in block], _BLOCK)

    with unmeasured_rows(rows.sparkSession):
        # the plan is made here, with the setting
        blocks = rows.mapInArrow(run, ", ".join(f"{c} string" for c in _BLOCK)).rdd
    return blocks.map(_as_batch).persist(StorageLevel.MEMORY_AND_DISK)


def without_keys(blocks: RDD) -> RDD:
    """The same blocks without keys, which only the picks need; these are kept and ``blocks`` no longer."""
    values = blocks.map(lambda block: block.select(["raw", "leaves"])).persist(StorageLevel.MEMORY_AND_DISK)
    values.count()
    blocks.unpersist()
    return values


def _as_batch(block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([binascii.a2b_base64(part)], pa.binary()) for part in block], _BLOCK)


def _unpacked(width: int):
    """(keys, raw values) of blocks with ``width`` columns."""

    def run(batches):
        for batch in batches:
            for keys, raw in zip(batch.column("keys"), batch.column("raw")):
                yield np.frombuffer(keys.as_buffer(), np.int64).reshape(-1, 3), np.frombuffer(raw.as_buffer()).reshape(-1, width)

    return run


def _picks(scale: Scale, chosen: np.ndarray | None, place: int, read):
    """Per task and start, the row whose exponential waiting time with rate d² (1 for the first centre) is shortest.

    The shortest of all rows is a draw with chances in proportion to d², the squared distance to the centres so far.
    """
    mixers = [_mixer(s, place) for s in range(STARTS)]

    def run(batches):
        best: dict[int, tuple[float, int, np.ndarray]] = {}

        def consider(s, rows, raw, high, row, second):
            _, _, c, d = mixers[s]
            x, low = scale(raw[rows]), (c * second[rows] + d) % PRIME
            wait = -np.log(1.0 - (high[rows] + (low + 1) / (PRIME + 1.0)) / PRIME)
            if chosen is not None:
                rate = _squares(x, chosen[s]).min(axis=1)
                wait = np.where(rate > 0, wait / np.where(rate > 0, rate, 1.0), np.inf)
            shortest = wait.min(initial=np.inf)
            if np.isfinite(shortest):
                first = np.flatnonzero(wait == shortest)
                at = first[row[rows][first].argmin()]
                found = (float(shortest), int(row[rows][at]), x[at])
                if s not in best or found[:2] < best[s][:2]:
                    best[s] = found

        for key, raw in read(batches):
            (row, first, second), corners = np.ascontiguousarray(key.T), scale(np.array([raw.min(axis=0), raw.max(axis=0)]))
            for s, (a, b, _, _) in enumerate(mixers):
                high = (a * first + b) % PRIME
                if s not in best:
                    consider(s, np.arange(min(TRIED, len(row))), raw, high, row, second)
                # no rate is above that of the farthest corner of the rows' box, so the first hash alone can rule a row out
                rate = 1.0 if chosen is None else ((corners[:, None] - chosen[s]) ** 2).max(axis=0).sum(axis=1).min()
                limit = PRIME * -np.expm1(-best[s][0] * rate) * (1 + 1e-9) + 1 if s in best else PRIME
                consider(s, np.flatnonzero(high <= limit), raw, high, row, second)
        rows = [{"start": s, "wait": w, "row": r, "x": x.tolist()} for s, (w, r, x) in best.items()]
        yield pa.RecordBatch.from_pylist(rows, _PICK)

    return run


_PICK = pa.schema([("start", pa.int32()), ("wait", pa.float64()), ("row", pa.int64()), ("x", pa.list_(pa.float64()))])
_PICK_DDL = "start int, wait double, row bigint, x array<double>"


class Nearest:
    """Every model's nearest centre for all rows of a block at once: one product of matrices, then comparisons."""

    def __init__(self, models: dict[int, np.ndarray]):
        self.flat = np.concatenate(list(models.values()))
        self.half = (self.flat**2).sum(axis=1)[:, None] / 2
        self.ends = np.cumsum([len(c) for c in models.values()])

    def __call__(self, x: np.ndarray):
        """Per model: the rows of each cluster as a cluster x row matrix, and |c|²/2 - c·x of the nearest centre c (the first of equals)."""
        gap = self.half - self.flat @ x.T
        for end, begin in zip(self.ends, [0, *self.ends[:-1]]):
            best = gap[begin:end].min(axis=0)
            mine = gap[begin:end] == best
            if np.count_nonzero(mine) > len(x):
                mine &= mine.cumsum(axis=0) == 1
            yield mine.astype(np.float64), best


def _as_rows(models, sums) -> pa.RecordBatch:
    """Cluster x column x 4 arrays of all models as rows (m, c, i, ...)."""
    place = [(m, c, i) for m, part in zip(models, sums) for c in range(part.shape[0]) for i in range(part.shape[1])]
    keys = np.array(place, dtype=np.int32).T
    values = np.concatenate([part.reshape(-1, len(_SUMS)) for part in sums]).T
    return pa.RecordBatch.from_arrays([pa.array(v) for v in [*keys, *values]], ["m", "c", "i", *_SUMS])


def _added(scale: Scale, models: dict[int, np.ndarray], measure):
    """A task's sums over its blocks of what ``measure`` gives for the raw values and the leaves."""
    width = len(scale.mean)

    def run(batches):
        sums = None
        for batch in batches:
            for values, cells in zip(batch.column("raw"), batch.column("leaves")):
                raw = np.frombuffer(values.as_buffer()).reshape(-1, width)
                parts = measure(raw, np.frombuffer(cells.as_buffer()).reshape(4, -1, width))
                sums = parts if sums is None else [p + q for p, q in zip(sums, parts)]
        if sums is not None:
            yield _as_rows(models, sums)

    return run


class Sides:
    """Every model's centre that is nearest in the whole box of a leaf, where there is one."""

    def __init__(self, models: dict[int, np.ndarray]):
        self.flat, self.ends = np.concatenate(list(models.values())), np.cumsum([len(c) for c in models.values()])
        self.half = (self.flat**2).sum(axis=1)[:, None] / 2
        self.pairs = [[(a, b) for b in range(len(c)) for a in range(b)] for c in models.values()]
        self.apart = np.concatenate([np.abs([c[b] - c[a] for a, b in pairs]) for c, pairs in zip(models.values(), self.pairs)])

    def __call__(self, middle: np.ndarray, reach: np.ndarray):
        """Per model: a cluster x leaf matrix with a 1 for the cluster that all rows of the leaf belong to."""
        gap = self.half - self.flat @ middle.T
        length = np.sqrt(2 * self.half.max())
        # the difference of two gaps is linear: over a box it varies by no more than this
        vary = self.apart @ reach.T + ROUNDING * length * (length + np.abs(middle).sum(axis=1) + reach.sum(axis=1))
        at = 0
        for end, begin, pairs in zip(self.ends, [0, *self.ends[:-1]], self.pairs):
            wins = np.ones((end - begin, len(middle)), bool)
            for a, b in pairs:
                more = gap[begin + b] - gap[begin + a]
                wins[a] &= more > vary[at]
                wins[b] &= more < -vary[at]
                at += 1
            yield wins.astype(np.float64)


def _assigned(scale: Scale, models: dict[int, np.ndarray], whole: bool = False):
    """Per task, model, cluster and column: rows and sum of values; as a ``whole`` also the sum of squares and the rows' squared distances to the centre."""
    sides, each = Sides(models), [(c, Nearest({m: c})) for m, c in models.items()]

    def measure(raw, leaves):
        parts, width = [], raw.shape[1]
        side, (middle, reach, total, squares) = np.ones(width), leaves
        won = list(sides(middle, reach))
        torn = [~wins.any(axis=0) for wins in won]
        # only rows that some model compares one by one are standardised
        some, end = np.logical_or.reduce(torn), len(middle) * LEAF
        cells = scale(raw[:end].reshape(-1, LEAF * width)[some].reshape(-1, width)).reshape(-1, LEAF * width)
        rest = scale(raw[end:])
        for (centres, nearest), wins, mine in zip(each, won, torn):
            n, s = LEAF * wins.sum(axis=1), wins @ total
            mixed = np.concatenate([cells[mine[some]].reshape(-1, width), rest])
            ((mine, gap),) = nearest(mixed)
            near, xx = np.zeros(len(centres)), np.zeros(centres.shape)
            if whole:
                inside = (wins @ squares).sum(axis=1) - 2 * (centres * s).sum(axis=1) + n * (centres**2).sum(axis=1)
                near = np.maximum(inside, 0.0) + mine @ np.maximum((mixed**2).sum(axis=1) + 2 * gap, 0.0)
                xx = wins @ squares + mine @ mixed**2
            n = n + mine.sum(axis=1)
            parts.append(np.stack([np.outer(n, side), s + mine @ mixed, xx, np.outer(near, side)], axis=2))
        return parts

    return _added(scale, models, measure)


_SUMS = ("n", "x", "xx", "near")


def _separated(scale: Scale, models: dict[int, np.ndarray], whole: dict[int, np.ndarray]):
    """Per task, model, cluster and column: rows, sum of raw values and the rows' silhouettes.

    The mean squared distance of a row to a cluster follows from the cluster's sums, so no pair of rows is formed.
    """
    nearest = Nearest(models)

    def measure(raw, leaves):
        x = scale(raw)
        parts, side, rows = [], np.ones(x.shape[1]), np.arange(len(x))
        for m, (mine, _) in zip(models, nearest(x)):
            label = mine.argmax(axis=0)
            n, s, q = whole[m][:, 0, 0], whole[m][:, :, 1], whole[m][:, :, 2].sum(axis=1)
            total = np.maximum((x * x).sum(axis=1)[:, None] * n + q - 2.0 * (x @ s.T), 0.0)
            own = total[rows, label] / np.maximum(n[label] - 1, 1)
            other = np.where(n > 0, total / np.maximum(n, 1), np.inf)
            other[rows, label] = np.inf
            other = other.min(axis=1)
            most = np.maximum(own, other)
            value = np.where((n[label] > 1) & (most > 0), (other - own) / np.where(most > 0, most, 1.0), 0.0)
            sizes, values = np.outer(mine.sum(axis=1), side), np.outer(mine @ value, side)
            parts.append(np.stack([sizes, mine @ raw, values, np.zeros(sizes.shape)], axis=2))
        return parts

    return _added(scale, models, measure)


def _summed(blocks: RDD, run, models: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The tasks' sums over ``blocks`` added up: per model a cluster x column x 4 array."""
    # every task's sums are in the order of the models
    added = blocks.mapPartitions(run).map(lambda sums: np.stack([sums.column(s).to_numpy() for s in _SUMS], axis=1)).reduce(np.add)
    sizes = [centres.size for centres in models.values()]
    parts = np.split(added, np.cumsum(sizes)[:-1])
    return {m: part.reshape(*models[m].shape, len(_SUMS)) for m, part in zip(models, parts)}


def starting_centres(rows: DataFrame | RDD, scale: Scale, most: int, read=_matrices) -> np.ndarray:
    """Start x place x column: the first k places of a start begin its model of k clusters.

    ``read`` gives the keys and values of ``rows``: a table (row id, two hashes, columns), or blocks of its rows.
    With fewer distinct rows than places, the last one found is repeated: its cluster stays empty.
    """
    chosen = None
    for place in range(most):
        run = _picks(scale, chosen, place, read)
        # a task gives ten rows at most
        batches = rows.mapPartitions(run).collect() if isinstance(rows, RDD) else rows.mapInArrow(run, _PICK_DDL).toArrow().to_batches()
        found = sorted(((r["start"], r["wait"], r["row"], r["x"]) for batch in batches for r in batch.to_pylist()), reverse=True)
        picked = {start: x for start, _, _, x in found}
        new = np.array([picked[s] if s in picked else chosen[s, -1] for s in range(STARTS)])[:, None, :]
        chosen = new if chosen is None else np.concatenate([chosen, new], axis=1)
    return chosen


def lloyd(blocks: RDD, scale: Scale, models: dict[int, np.ndarray], tolerance: float) -> dict[int, np.ndarray]:
    """Centres after Lloyd's steps; a model leaves once its centres move by no more than the tolerance. Empty clusters stay."""
    done, active = {}, dict(models)
    for _ in range(STEPS):
        sums = _summed(blocks, _assigned(scale, active), active)
        moved = {}
        for m, old in active.items():
            n = sums[m][:, :, 0]
            new = np.where(n > 0, sums[m][:, :, 1] / np.maximum(n, 1), old)
            (done if ((new - old) ** 2).sum() <= tolerance else moved)[m] = new
        active = moved
        if not active:
            break
    return {m: (done | active)[m] for m in models}


def segments(df: DataFrame, columns: list[str]) -> tuple[DataFrame | None, float | None, str | None]:
    """(cluster profile, silhouette, reason): the reason is set when there is no profile.

    Profile rows: cluster, name, size, pct_of_data and mean_<column> in raw units. Rows with a missing value take no part.
    Of ten starts a k the one with the least sum of squared distances counts; of the ks the one with the largest silhouette
    (of squared distances, linear cost; the pairwise one would be quadratic in the rows), the smaller k first.
    """
    spark = df.sparkSession
    # row ids are read only where there is something to segment
    if len(columns) < MIN_COLUMNS:
        return None, None, TOO_FEW_COLUMNS
    ship_package(spark)
    nums = numeric_frame(with_row_id(df), columns, [ROW_ID]).na.drop(subset=columns)
    stats = [f(col(c)) for c in columns for f in (F.avg, F.stddev_pop, F.min, F.max)]
    n, *head = nums.agg(F.count("*"), *stats).first()
    reason = not_applicable(columns, n)
    if reason:
        return None, None, reason
    mean, std, low, high = (head[i::4] for i in range(4))
    live = [a != b for a, b in zip(low, high)]
    if not any(live):
        return None, None, ALL_ALIKE
    if not np.isfinite(low + high).all():
        return None, None, INFINITE
    scale = Scale(mean, [s if ok else 1.0 for s, ok in zip(std, live)])
    digest = F.md5(F.concat_ws(":", F.lit(str(SEED)), F.lit("row"), col(ROW_ID).cast("string")).cast("binary"))
    # digits become numbers in the tasks: conv() would take several times as long as the digest
    hashes = [F.substring(digest, at, 8).alias(f"_row_hash{at}") for at in (1, 9)]
    rows = spread(nums, n).select(ROW_ID, *hashes, *[col(c) for c in columns])
    blocks = kept_blocks(rows, scale)
    try:
        ks = candidate_ks(n)
        starts = starting_centres(blocks, scale, ks[-1], _unpacked(len(columns)))
        blocks = without_keys(blocks)
        models = {STARTS * k + s: starts[s, :k] for k in ks for s in range(STARTS)}
        models = lloyd(blocks, scale, models, TOLERANCE * sum(live) / len(live))
        sums = _summed(blocks, _assigned(scale, models, whole=True), models)
        spread_of = {m: sums[m][:, 0, 3].sum() for m in models}
        least = {k: min(spread_of[STARTS * k + s] for s in range(STARTS)) for k in ks}
        # starts that end in the same clusters differ by rounding only: the first of them counts
        best = {k: next(m for m in range(STARTS * k, STARTS * k + STARTS) if spread_of[m] <= ALIKE * least[k]) for k in ks}
        kept = {m: models[m] for k, m in best.items() if (sums[m][:, 0, 0] > 0).sum() > 1}
        apart = _summed(blocks, _separated(scale, kept, {m: sums[m] for m in kept}), kept) if kept else {}
    finally:
        blocks.unpersist()
    if not kept:
        return None, None, ALL_ALIKE
    score = {m: apart[m][:, 0, 2].sum() / n for m in kept}
    winner = max(kept, key=lambda m: score[m])
    size, raw = apart[winner][:, 0, 0], apart[winner][:, :, 1]
    found = [(c, int(size[c]), *(raw[c] / size[c]).tolist()) for c in range(len(size)) if size[c] > 0]
    profile = spark.createDataFrame(found, "cluster int, size bigint, " + ", ".join(f"`mean_{c}` double" for c in columns))
    return name_segments(profile, columns), float(score[winner]), None


def name_segments(profile: DataFrame, columns: list[str]) -> DataFrame:
    """Names by the sum of raw means; at most four rows, one per cluster."""
    total = sum((col(f"mean_{c}") for c in columns), F.lit(0.0))
    everything = Window.partitionBy(F.lit(1))
    ranked = (
        profile.withColumn("_total", total)
        .withColumn("_k", F.count("*").over(everything))
        .withColumn("_rank", F.row_number().over(everything.orderBy(F.desc("_total"), "cluster")))
        .withColumn("_rows", F.sum("size").over(everything))
    )
    name = (
        F.when(F.col("_rank") == 1, HIGH)
        .when(F.col("_rank") == F.col("_k"), BASE)
        .when(F.col("_rank") == 2, MIDDLE)
        .otherwise(F.concat(F.lit("Segment "), (F.col("cluster") + 1).cast("string")))
    )
    return ranked.select(
        "cluster",
        name.alias("name"),
        "size",
        F.round(100.0 * F.col("size") / F.col("_rows"), 1).alias("pct_of_data"),
        *[F.round(col(f"mean_{c}"), 2).alias(f"mean_{c}") for c in columns],
    )
