"""Correlation, regression and what-if estimates, each from one aggregate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.counts import one_row
from sheetlens.functions.values import col, field_type, fixed, numeric, numeric_frame
from sheetlens.session import ship_package, small_frame

# Thresholds and sizes of the reports.
MODERATE_R, STRONG_R = 0.35, 0.6
TOP_PAIRS, TOP_OPTIONS = 10, 8
WHAT_IF_MIN_ROWS = 5
PAIRS_PER_JOB = 400
WHAT_IF_DDL = (
    "success boolean, driver_column string, target_column string, percentage_change double, current_driver_mean double, "
    "simulated_driver_mean double, current_target_value double, simulated_target_value double, estimated_change double, "
    "percentage_change_result double, correlation double, r_squared double, confidence_score int, summary string, error string"
)

_HEADS = (("n", F.count), ("mean", F.avg), ("lo", F.min), ("hi", F.max))


def pearson(a: Column, b: Column) -> Column:
    """Pearson r over complete pairs, 0 when either side is constant.

    ``corr`` fails on constant input under ANSI rules, hence the covariance form.
    """
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.coalesce(F.try_divide(F.covar_pop(a, b), spread), F.lit(0.0))


def _gram_sums(shift: np.ndarray, complete: bool):
    """Sums over pairs of columns (i <= j) of a task's rows, each value less its column's ``shift``.

    With X the shifted values (0 where missing) and M the presence: XᵀX, and unless all are present also XᵀM, MᵀX
    (sums of one side where both are there), X²ᵀM, MᵀX² (squares) and MᵀM (counts). A task holds these matrices only.
    """
    upper = np.triu_indices(len(shift))

    def run(batches):
        sums = None
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64, copy=False)
            present = ~np.isnan(values)
            x = np.where(present, values - shift, 0.0)
            parts = [x.T @ x]
            if not complete:
                m = present.astype(np.float64)
                side, square = x.T @ m, (x * x).T @ m
                parts += [side, side.T, square, square.T, m.T @ m]
            sums = parts if sums is None else [a + b for a, b in zip(sums, parts)]
        if sums is not None:
            flat = [pa.array(s[upper]) for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *flat], ["i", "j", *_GRAM[: len(flat)]])

    return run


_GRAM = ("xy", "x", "y", "xx", "yy", "n")
#: A side whose spread is this small beside its distance from the column's mean is looked at again, value by value.
DOUBTFUL = 1e-9


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per unordered pair (order_a < order_b) plus the diagonal: r over complete pairs, unrounded.

    One scan gives counts, means and ranges, a second one the sums of products of all pairs, however many columns there
    are: tasks add up matrices over Arrow batches, and Spark adds those by pair. Pairs in which one side may be
    constant where both are present are taken again, 400 a job, by a covariance that sees each value, which is exact there.
    """
    spark = df.sparkSession
    ship_package(spark)
    nums = numeric_frame(df, columns)
    heads = [f(col(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in _HEADS]
    head = one_row(nums, [F.count("*").alias("rows"), *heads])
    live = [i for i in range(len(columns)) if head[f"lo{i}"] is not None and head[f"lo{i}"] != head[f"hi{i}"]]
    full = np.array([head[f"n{i}"] == head["rows"] for i in live], bool)
    r = np.zeros((len(columns), len(columns)))
    if len(live) > 1:
        complete = bool(full.all())
        shift = np.array([head[f"mean{i}"] for i in live])
        used = _GRAM[:1] if complete else _GRAM
        ddl = "i int, j int, " + ", ".join(f"{k} double" for k in used)
        sums = nums.select(*[col(columns[i]) for i in live]).mapInArrow(_gram_sums(shift, complete), ddl)
        added = sums.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in used]).toArrow()
        i, j, xy, *rest = (added.column(k).to_numpy() for k in ("i", "j", *used))
        square = np.zeros(len(live))
        square[i[i == j]] = xy[i == j]
        with np.errstate(divide="ignore", invalid="ignore"):
            found = xy / (np.sqrt(square[i]) * np.sqrt(square[j]))
            if not complete:
                x, y, xx, yy, n = rest
                gap = ~(full[i] & full[j])
                spread_x, spread_y = xx - x * x / n, yy - y * y / n
                found[gap] = ((xy - x * y / n) / (np.sqrt(np.maximum(spread_x, 0)) * np.sqrt(np.maximum(spread_y, 0))))[gap]
                doubtful = gap & (i < j) & (n > 0) & ((spread_x <= DOUBTFUL * xx) | (spread_y <= DOUBTFUL * yy))
                found[gap & (n == 0)] = 0.0
                again = list(zip(i[doubtful].tolist(), j[doubtful].tolist()))
                exact = []
                for start in range(0, len(again), PAIRS_PER_JOB):
                    part = again[start : start + PAIRS_PER_JOB]
                    exact += nums.agg(*[pearson(col(columns[live[a]]), col(columns[live[b]])) for a, b in part]).first()
                found[doubtful] = exact
            found[(square[i] == 0) | (square[j] == 0)] = 0.0
        at = np.array(live)
        r[at[i], at[j]] = found
    for k in live:
        r[k, k] = 1.0
    a, b = np.triu_indices(len(columns))
    names = np.array(columns, dtype=object)
    table = pa.table(
        {
            "order_a": pa.array(a, pa.int32()), "order_b": pa.array(b, pa.int32()), "col_a": pa.array(names[a], pa.string()),
            "col_b": pa.array(names[b], pa.string()), "r": pa.array(r[a, b]),
        }
    )
    return spark.createDataFrame(table, "order_a int, order_b int, col_a string, col_b string, r double")


def _mirrored(pairs: DataFrame) -> DataFrame:
    """Each unordered pair in both directions."""
    both = F.array(
        F.struct("order_a", "order_b", "col_a", "col_b", "r"),
        F.struct(
            F.col("order_b").alias("order_a"),
            F.col("order_a").alias("order_b"),
            F.col("col_b").alias("col_a"),
            F.col("col_a").alias("col_b"),
            "r",
        ),
    )
    return pairs.where(F.col("order_a") < F.col("order_b")).select(F.inline(both))


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Full matrix as rows (col_a, col_b, r), rounded."""
    diagonal = pairs.where(F.col("order_a") == F.col("order_b"))
    return _mirrored(pairs).unionByName(diagonal).select("col_a", "col_b", F.round("r", 3).alias("r"))


def significant_pairs(pairs: DataFrame, k: int | None = TOP_PAIRS) -> DataFrame:
    """Pairs of at least moderate strength, strongest first."""
    r = F.col("r")
    rows = (
        pairs.where((F.col("order_a") < F.col("order_b")) & (F.abs(r) >= MODERATE_R))
        .select(
            F.col("col_a").alias("column_a"),
            F.col("col_b").alias("column_b"),
            F.round(r, 3).alias("correlation"),
            F.when(F.abs(r) >= STRONG_R, "strong").otherwise("moderate").alias("strength"),
            F.when(r > 0, "positive").otherwise("negative").alias("direction"),
            "order_a",
            "order_b",
            r.alias("raw_r"),
        )
        .orderBy(F.desc(F.abs("correlation")), "order_a", "order_b")
    )
    return rows.limit(k) if k else rows


def explained(pairs: DataFrame) -> DataFrame:
    """Significant pairs with their one-line reading."""
    # fixed value: the sentence
    text = F.format_string(
        "%s and %s show a %s %s correlation (r = %s). "
        "Note: This indicates a statistical association and does not imply causation.",
        "column_a",
        "column_b",
        "strength",
        "direction",
        fixed("raw_r"),
    )
    return pairs.withColumn("explanation", text).drop("raw_r")


def strongest(pairs: DataFrame) -> DataFrame:
    """The strongest pair of each direction (all significant pairs, not only the top ten)."""
    ranked = significant_pairs(pairs, None)
    best = F.max_by(
        F.struct("column_a", "column_b", "correlation", "strength"),
        F.struct(F.abs("correlation"), -F.col("order_a"), -F.col("order_b")),
    )
    return ranked.groupBy("direction").agg(best.alias("b")).select("direction", "b.*")


def what_if_options(pairs: DataFrame, k: int = TOP_OPTIONS) -> DataFrame:
    """Driver and target pairs worth simulating, from the correlation rows."""
    return (
        _mirrored(pairs)
        .select(
            F.col("col_a").alias("driver"),
            F.col("col_b").alias("target"),
            F.round("r", 2).alias("correlation"),
            F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("relationship"),
            "order_a",
            "order_b",
        )
        .orderBy(F.desc(F.abs("correlation")), "order_a", "order_b")
        .limit(k)
        .drop("order_a", "order_b")
    )


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, r and r² of complete pairs; slope is NULL for a constant x."""
    return _moments(df, x, y).select(
        "n",
        F.round("slope", 6).alias("slope"),
        F.round("intercept", 4).alias("intercept"),
        F.round("r", 4).alias("r"),
        F.round(F.col("r") * F.col("r"), 4).alias("r_squared"),
    )


def _moments(df: DataFrame, x: str, y: str) -> DataFrame:
    pairs = df.select(numeric(x, field_type(df, x)).alias("x"), numeric(y, field_type(df, y)).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )
    slope = F.try_divide(F.covar_pop("x", "y"), F.var_pop("x"))
    return pairs.agg(
        F.count("*").alias("n"),
        F.sum("x").alias("sx"),
        F.sum("y").alias("sy"),
        slope.alias("slope"),
        (F.avg("y") - slope * F.avg("x")).alias("intercept"),
        pearson(F.col("x"), F.col("y")).alias("r"),
    )


def what_if(df: DataFrame, driver: str, target: str, percentage_change: float) -> DataFrame:
    """Estimated change of the target when the driver moves by a percentage.

    The sum over simulated rows has the closed form slope * factor * Σx + n * intercept.
    """
    if driver not in df.columns or target not in df.columns:
        # fixed value: the message
        message = f"Columns {driver} or {target} not found in dataset."
        return small_frame(df.sparkSession, [{"success": False, "error": message}], WHAT_IF_DDL)
    factor = 1.0 + percentage_change / 100.0
    ok = (F.col("n") >= WHAT_IF_MIN_ROWS) & F.col("slope").isNotNull()
    m = _moments(df, driver, target).withColumn("success", ok)
    m = m.withColumn("sim", F.col("slope") * factor * F.col("sx") + F.col("n") * F.col("intercept"))
    m = m.withColumn("delta", F.col("sim") - F.col("sy"))
    m = m.withColumn("pct", F.coalesce(F.try_divide(100 * F.col("delta"), F.col("sy")), F.lit(0.0)))
    r2 = F.col("r") * F.col("r")
    mean = F.try_divide(F.col("sx"), F.col("n"))
    direction = "increase" if percentage_change > 0 else "decrease"
    # fixed value: the sentence that reports an estimate
    summary = F.format_string(
        "If %s experiences a %s%% %s, %s is projected to %s by approximately %.1f%% (%+,.2f total change, r = %.2f).",
        F.lit(driver),
        F.lit(f"{abs(percentage_change)}"),
        F.lit(direction),
        F.lit(target),
        F.when(F.col("delta") > 0, "increase").otherwise("decrease"),
        F.abs("pct"),
        "delta",
        "r",
    )

    def shown(c: Column, digits: int) -> Column:
        return F.when(F.col("success"), F.round(c, digits))

    return m.select(
        "success",
        F.lit(driver).alias("driver_column"),
        F.lit(target).alias("target_column"),
        F.lit(float(percentage_change)).alias("percentage_change"),
        shown(mean, 2).alias("current_driver_mean"),
        shown(mean * factor, 2).alias("simulated_driver_mean"),
        shown(F.col("sy"), 2).alias("current_target_value"),
        shown(F.col("sim"), 2).alias("simulated_target_value"),
        shown(F.col("delta"), 2).alias("estimated_change"),
        shown(F.col("pct"), 2).alias("percentage_change_result"),
        shown(F.col("r"), 3).alias("correlation"),
        shown(r2, 3).alias("r_squared"),
        F.when(F.col("success"), F.least(F.lit(95), F.greatest(F.lit(40), F.floor(r2 * 100)))).cast("int").alias("confidence_score"),
        F.when(F.col("success"), summary).alias("summary"),
        # fixed value: the message
        F.when(~F.col("success"), F.lit("Not enough data points to compute simulation model.")).alias("error"),
    )
