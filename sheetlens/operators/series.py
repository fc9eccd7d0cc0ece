"""Monthly series: calendar filling, period changes, trends and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.functions.values import col, field_type, numeric, period_start

# Thresholds of the trend and period-change rules.
TREND_MIN_ROWS, TREND_MIN_MONTHS = 5, 3
STABLE_BELOW_R = 0.3
PERIOD_MIN_VALUES, PERIOD_MIN_MONTHS, PERIOD_MIN_CHANGE = 10, 3, 20.0


def fill_calendar(sums: DataFrame, unit: str, measures: list[str], bounds: tuple | None = None) -> DataFrame:
    """Every period between the first and the last one, missing sums as 0."""
    if bounds is None:
        ends = sums.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    else:
        ends = sums.sparkSession.range(1).select(
            period_start(F.lit(bounds[0]), unit).alias("lo"), period_start(F.lit(bounds[1]), unit).alias("hi")
        )
    step = F.expr(f"interval 1 {unit}")
    calendar = ends.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi", step)).alias("period"))
    return calendar.join(sums, "period", "left").select(
        "period", *[F.coalesce(col(m), F.lit(0.0)).alias(m) for m in measures]
    )


def monthly_sums(df: DataFrame, ts: Column, measures: list[str]) -> DataFrame:
    """(col, month, v, cnt) for all measures from one group-by on the month.

    The wide table has one row per month, so unpivoting it costs nothing.
    """
    rows = df.select(
        period_start(ts, "month").alias("month"),
        *[numeric(m, field_type(df, m)).alias(f"m{i}") for i, m in enumerate(measures)],
    ).where(F.col("month").isNotNull())
    aggs = [a for i in range(len(measures)) for a in (F.sum(f"m{i}").alias(f"s{i}"), F.count(f"m{i}").alias(f"c{i}"))]
    wide = rows.groupBy("month").agg(*aggs)
    pieces = [
        F.struct(F.lit(i).alias("col_order"), F.lit(m).alias("col"), F.col(f"s{i}").alias("v"), F.col(f"c{i}").alias("cnt"))
        for i, m in enumerate(measures)
    ]
    return wide.select("month", F.inline(F.array(*pieces))).where(F.col("cnt") > 0)


def _linear_fit(x: str, y: str) -> list[Column]:
    """Slope and r over the group; r is 0 when either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))
    return [F.regr_slope(y, x).alias("slope"), r.alias("r")]


def trends(monthly: DataFrame) -> DataFrame:
    """Direction, slope, fit and extremes per measure, from ``monthly_sums``.

    Months that sum to 0 are left out; positions count the months that remain.
    """
    order = Window.partitionBy("col").orderBy("month")
    used = (
        monthly.withColumn("rows", F.sum("cnt").over(Window.partitionBy("col")))
        .where(F.col("v") != 0)
        .withColumn("i", F.row_number().over(order) - 1)
    )
    fits = used.groupBy("col_order", "col").agg(
        F.max("rows").alias("rows"),
        F.count("*").alias("periods"),
        *_linear_fit("i", "v"),
        F.min_by("v", "i").alias("first"),
        F.max_by("v", "i").alias("last"),
        F.max(F.struct("v", (-F.col("i")).alias("back"), "month")).alias("hi"),
        F.min(F.struct("v", "i", "month")).alias("lo"),
    )
    direction = (
        F.when(F.abs("r") < STABLE_BELOW_R, "stable/fluctuating")
        .when(F.col("slope") > 0, "increasing")
        .otherwise("decreasing")
    )
    change = F.try_divide(100 * (F.col("last") - F.col("first")), F.col("first"))
    return fits.where((F.col("rows") >= TREND_MIN_ROWS) & (F.col("periods") >= TREND_MIN_MONTHS)).select(
        "col_order",
        F.col("col").alias("column"),
        direction.alias("direction"),
        F.round("slope", 4).alias("slope"),
        F.round(F.col("r") * F.col("r"), 3).alias("r_squared"),
        F.round(change, 1).alias("total_pct_change"),
        F.col("periods").alias("periods_analyzed"),
        F.date_format("hi.month", "yyyy-MM").alias("peak_period"),
        F.round("hi.v", 2).alias("peak_value"),
        F.date_format("lo.month", "yyyy-MM").alias("trough_period"),
        F.round("lo.v", 2).alias("trough_value"),
    )


def period_changes(monthly: DataFrame) -> DataFrame:
    """Change against the month before, gaps counted as 0; NULL after a month of 0."""
    spans = monthly.groupBy("col_order", "col").agg(
        F.min("month").alias("lo"), F.max("month").alias("hi"), F.sum("cnt").alias("rows")
    )
    calendar = spans.select(
        "col_order", "col", "rows", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month")
    )
    full = calendar.join(monthly.select("col", "month", "v"), ["col", "month"], "left")
    v = F.coalesce("v", F.lit(0.0))
    order = Window.partitionBy("col").orderBy("month")
    before = F.lag(v).over(order)
    return full.select(
        "col_order",
        "col",
        "month",
        "rows",
        F.count("*").over(Window.partitionBy("col")).alias("months"),
        F.round(v, 2).alias("value"),
        F.try_divide(100 * (v - before), before).alias("pct_change"),
    )


def period_anomalies(monthly: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """The month with the largest change per measure, if it is large enough."""
    changes = period_changes(monthly)
    enough = F.col("rows") if counts is None else F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col("col")]
    eligible = changes.where((enough >= PERIOD_MIN_VALUES) & (F.col("months") >= PERIOD_MIN_MONTHS))
    size = F.abs("pct_change")
    first = F.row_number().over(Window.partitionBy("col").orderBy(F.desc_nulls_last(size), F.asc("month")))
    worst = eligible.withColumn("_rank", first).where((F.col("_rank") == 1) & (size >= PERIOD_MIN_CHANGE))
    return worst.select(
        "col_order",
        F.col("col").alias("column"),
        F.date_format("month", "MMMM yyyy").alias("period"),
        F.round("pct_change", 1).alias("pct_change"),
        F.when(F.col("pct_change") < 0, "decrease").otherwise("increase").alias("direction"),
    )


def growth(monthly: DataFrame) -> DataFrame:
    """Last against first non-zero month, per measure with at least two of them."""
    ends = (
        monthly.where(F.col("v") != 0)
        .groupBy("col_order", "col")
        .agg(F.min_by("v", "month").alias("a"), F.max_by("v", "month").alias("b"), F.count("*").alias("months"))
    )
    return ends.where(F.col("months") >= 2).select(
        "col_order",
        F.col("col").alias("column"),
        "months",
        F.round(F.try_divide(100 * (F.col("b") - F.col("a")), F.col("a")), 1).alias("growth_pct"),
    )
