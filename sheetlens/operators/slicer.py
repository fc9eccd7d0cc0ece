"""Chart series recomputed on sliced rows, by the rules of the interactive view.

They differ from the first rendering: missing categories show as "Unknown", missing
numbers count as 0, histogram bins are left-closed and quartiles are plain ranks.
"""

from __future__ import annotations

from math import floor, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.quantiles import exact_ranks
from sheetlens.functions.values import col, field_type, numeric
from sheetlens.session import small_frame
from sheetlens.sources.row_ids import ROW_ID, with_row_id

# Sizes of the recomputed charts.
BAR_GROUPS, BAR_LABEL = 8, 18
PIE_GROUPS, PIE_LABEL = 6, 15
SCATTER_POINTS = 60
UNKNOWN = "Unknown"


def _totals(df: DataFrame, category: str, measure: str) -> DataFrame:
    value = F.coalesce(numeric(measure, field_type(df, measure)), F.lit(0.0))
    label = F.coalesce(col(category).cast("string"), F.lit(UNKNOWN))
    sums = df.select(label.alias("label"), value.alias("v")).groupBy("label").agg(F.sum("v").alias("v"))
    return sums.select("label", F.round("v", 2).alias("value"))


def _top(df: DataFrame, category: str, measure: str, k: int, width: int) -> DataFrame:
    top = _totals(df, category, measure).orderBy(F.desc("value"), F.asc("label")).limit(k)
    return top.select(F.substring("label", 1, width).alias("label"), "value")


def bar(df: DataFrame, category: str, measure: str) -> DataFrame:
    return _top(df, category, measure, BAR_GROUPS, BAR_LABEL)


def ranking(df: DataFrame, category: str, measure: str) -> DataFrame:
    return bar(df, category, measure).orderBy(F.asc("value"), F.desc("label"))


def pie(df: DataFrame, category: str, measure: str) -> DataFrame:
    return _top(df, category, measure, PIE_GROUPS, PIE_LABEL)


def _values(df: DataFrame, measure: str) -> DataFrame:
    return df.select(numeric(measure, field_type(df, measure)).alias("v")).where(F.col("v").isNotNull())


def histogram(df: DataFrame, measure: str) -> DataFrame:
    """(bin, left_edge, right_edge, count) with 4 to 8 left-closed bins."""
    values = _values(df, measure)
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    ddl = "bin int, left_edge double, right_edge double"
    if not n:
        return small_frame(df.sparkSession, [], ddl + ", count bigint")
    bins = min(8, max(4, isqrt(n)))
    width = (high - low) / bins or 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(width))).cast("int")
    counted = values.select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    edges = [{"bin": i, "left_edge": low + i * width, "right_edge": low + (i + 1) * width} for i in range(bins)]
    return (
        small_frame(df.sparkSession, edges, ddl)
        .join(counted, "bin", "left")
        .select(
            "bin",
            F.round("left_edge").alias("left_edge"),
            F.round("right_edge").alias("right_edge"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def box(df: DataFrame, measure: str) -> DataFrame:
    """Box summary with quartiles at rank floor(n * q) and fences that are not clipped."""
    values = _values(df, measure)
    n, low, high, mean = values.agg(F.count("*"), F.min("v"), F.max("v"), F.round(F.avg("v"), 2)).first()
    ddl = "metric string, min double, q1 double, median double, q3 double, max double, mean double"
    if not n:
        return small_frame(df.sparkSession, [], ddl + ", outlier_count bigint")
    q1, q2, q3 = exact_ranks(values, "v", n, [floor(n * q) for q in (0.25, 0.5, 0.75)])
    lower, upper = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    outside = F.count(F.when((F.col("v") < F.lit(lower)) | (F.col("v") > F.lit(upper)), 1))
    shown = {"metric": measure, "min": low, "q1": q1, "median": q2, "q3": q3, "max": high, "mean": mean}
    return values.agg(outside.alias("outlier_count")).select(
        *[F.lit(v).alias(k) for k, v in shown.items()], "outlier_count"
    )


def line(df: DataFrame, ts: Column, measures: list[str]) -> DataFrame:
    """Sums per calendar month that has rows; no gaps are filled."""
    values = [F.coalesce(numeric(m, field_type(df, m)), F.lit(0.0)).alias(m) for m in measures]
    rows = df.select(F.date_format(ts, "yyyy-MM").alias("date"), *values).where(F.col("date").isNotNull())
    sums = rows.groupBy("date").agg(*[F.sum(col(m)).alias(m) for m in measures])
    return sums.select("date", *[F.round(col(m), 2).alias(m) for m in measures])


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """The first complete pairs in row order."""
    rows = with_row_id(df)
    pairs = rows.select(
        ROW_ID, numeric(x, field_type(rows, x)).alias("x"), numeric(y, field_type(rows, y)).alias("y")
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return pairs.orderBy(ROW_ID).limit(SCATTER_POINTS).drop(ROW_ID)


def kpis(df: DataFrame, measure: str) -> DataFrame:
    """Total of the primary measure and the number of rows left."""
    value = F.coalesce(numeric(measure, field_type(df, measure)), F.lit(0.0))
    return df.agg(F.count("*").alias("filtered_rows"), F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2).alias("total")).select(
        F.lit(measure).alias("measure"), "total", "filtered_rows"
    )
