"""Univariate outliers, anomaly records and their totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.functions.counts import one_row, union_all
from sheetlens.functions.quantiles import exact_quantiles
from sheetlens.functions.values import col, field_type, fixed, grouped_number, numeric, numeric_frame
from sheetlens.session import small_frame
from sheetlens.sources.row_ids import ROW_ID

# Thresholds and report sizes.
MIN_VALUES = 10
Z_LIMIT = 3.0
IQR_FACTOR = 1.5
PER_COLUMN, FOREST_RECORDS, ALL_RECORDS = 3, 15, 25
FOREST_SCORE = 92

RECORD_DDL = (
    "id string, row_id bigint, column string, value double, expected_range string, method string, "
    "severity string, anomaly_score int, explanation string"
)


@dataclass
class Bounds:
    """Centre, spread and fences of one column."""

    column: str
    count: int
    mean: float
    std: float
    q1: float
    q3: float

    @property
    def lower(self) -> float:
        return self.q1 - IQR_FACTOR * (self.q3 - self.q1)

    @property
    def upper(self) -> float:
        return self.q3 + IQR_FACTOR * (self.q3 - self.q1)

    def outside(self, v: Column) -> Column:
        return (v < F.lit(self.lower)) | (v > F.lit(self.upper))

    def z(self, v: Column) -> Column:
        return F.abs(v - F.lit(self.mean)) / F.lit(self.std) if self.std else F.lit(None).cast("double")


def outlier_bounds(df: DataFrame, columns: list[str]) -> list[Bounds]:
    """Bounds of the columns with at least ten values: one aggregate plus the quartiles."""
    if not columns:
        return []
    nums = numeric_frame(df, columns)
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(col(c)).alias(f"n{i}"), F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}")]
    row = one_row(nums, aggs)
    kept = [i for i, c in enumerate(columns) if row[f"n{i}"] >= MIN_VALUES]
    quartiles = exact_quantiles(nums, [columns[i] for i in kept], [0.25, 0.75], {columns[i]: row[f"n{i}"] for i in kept})
    return [
        Bounds(columns[i], row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], *quartiles[columns[i]]) for i in kept
    ]


def univariate_outliers(df: DataFrame, bounds: list[Bounds]) -> DataFrame:
    """Number of z-score and IQR outliers per column, in one aggregate."""
    ddl = "col_order int, column string, zscore_outliers bigint, iqr_outliers bigint"
    if not bounds:
        return small_frame(df.sparkSession, [], ddl)
    nums = numeric_frame(df, [b.column for b in bounds])
    aggs, pieces = [], []
    for i, b in enumerate(bounds):
        v = col(b.column)
        aggs.append(F.count(F.when(b.z(v) > Z_LIMIT, 1)).alias(f"z{i}"))
        aggs.append(F.count(F.when(b.outside(v), 1)).alias(f"i{i}"))
        pieces.append(
            F.struct(
                F.lit(i).alias("col_order"),
                F.lit(b.column).alias("column"),
                F.col(f"z{i}").alias("zscore_outliers"),
                F.col(f"i{i}").alias("iqr_outliers"),
            )
        )
    return nums.agg(*aggs).select(F.inline(F.array(*pieces)))


def iqr_records(df: DataFrame, bounds: list[Bounds]) -> DataFrame:
    """The first three outliers per column in row order, scored by their z value.

    One filtered top-k per column: the fence reaches the Parquet scan as a range predicate.
    """
    parts = []
    for i, b in enumerate(bounds):
        v = numeric(b.column, field_type(df, b.column))
        score = F.least(F.lit(98), 80 + F.floor(F.coalesce(b.z(F.col("raw")), F.lit(0.0)) * 5)).cast("int")
        first = df.where(b.outside(v)).select(ROW_ID, v.alias("raw")).orderBy(ROW_ID).limit(PER_COLUMN)
        # fixed value: the sentence that explains a record
        text = F.format_string(
            f"Value %s is substantially outside the normal expected range ({b.lower:.1f} to {b.upper:.1f}).", fixed("raw")
        )
        parts.append(
            first.select(
                F.lit(i).alias("col_order"),
                F.concat(F.lit(f"anomaly_{b.column}_"), F.col(ROW_ID)).alias("id"),
                F.col(ROW_ID).alias("row_id"),
                F.lit(b.column).alias("column"),
                F.round("raw", 2).alias("value"),
                F.lit(f"{b.lower:.1f} – {b.upper:.1f}").alias("expected_range"),
                F.lit("IQR & Z-Score").alias("method"),
                score.alias("anomaly_score"),
                text.alias("explanation"),
            )
        )
    if not parts:
        return small_frame(df.sparkSession, [], "col_order int, " + RECORD_DDL)
    return union_all(parts).withColumn("severity", F.when(F.col("anomaly_score") >= 90, "High").otherwise("Medium"))


def flagged_records(first: DataFrame) -> DataFrame:
    """Records of the first rows a forest flagged; each names the column with its largest raw value."""
    # fixed value: the sentence that explains a record
    text = F.format_string(
        "Multivariate outlier flagged across numerical attributes (%s = %s).", F.col("top_column"), grouped_number(F.col("top_value"))
    )
    return first.select(
        F.lit(-1).alias("col_order"),
        F.concat(F.lit("anomaly_"), F.col(ROW_ID)).alias("id"),
        F.col(ROW_ID).alias("row_id"),
        F.col("top_column").alias("column"),
        F.col("top_value").alias("value"),
        F.lit(None).cast("string").alias("expected_range"),
        F.lit("Isolation Forest").alias("method"),
        F.lit(FOREST_SCORE).alias("anomaly_score"),
        text.alias("explanation"),
        F.lit("High").alias("severity"),
    )


def merge_records(forest: DataFrame | None, univariate: DataFrame) -> DataFrame:
    """Report of at most 25 records: forest rows first, then columns in order."""
    rows = univariate if forest is None else forest.unionByName(univariate)
    top = rows.orderBy("col_order", "row_id").limit(ALL_RECORDS)
    order = Window.partitionBy(F.lit(1)).orderBy("col_order", "row_id")
    return top.withColumn("record", F.row_number().over(order)).drop("col_order")


def with_row_index(records: DataFrame, df: DataFrame) -> DataFrame:
    """Dense 1-based position of each record's row.

    The count of earlier rows comes from one pass per report: every row is compared with
    at most 25 literal ids, so nothing is sorted.
    """
    ids = [r["row_id"] for r in records.select("row_id").distinct().collect()]
    if not ids:
        return records.withColumn("row_index", F.lit(None).cast("bigint"))
    before = df.agg(*[F.count(F.when(F.col(ROW_ID) < F.lit(i), 1)).alias(f"b{k}") for k, i in enumerate(ids)])
    pieces = [F.struct(F.lit(i).alias("row_id"), (F.col(f"b{k}") + 1).alias("row_index")) for k, i in enumerate(ids)]
    return records.join(before.select(F.inline(F.array(*pieces))), "row_id")


def total_anomalies(flagged: DataFrame | None, records: DataFrame) -> DataFrame:
    """Distinct rows flagged by the forest or named in a record."""
    named = records.select("row_id")
    ids = named if flagged is None else flagged.select(F.col(ROW_ID).alias("row_id")).unionByName(named)
    return ids.distinct().agg(F.count("*").alias("total_anomalies"))
