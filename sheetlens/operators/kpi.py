"""Headline numbers and the catalogue of available filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.counts import union_all
from sheetlens.functions.names import is_slicer_name
from sheetlens.functions.values import col, field_type, fixed, numeric
from sheetlens.operators.profile import TableTypes
from sheetlens.operators.series import growth, monthly_sums
from sheetlens.session import small_frame

# Report sizes and the score shown when a table was not cleaned here.
MAX_KPIS, MAX_OPTIONS = 4, 25
DEFAULT_QUALITY = 96.7


def money(c: Column) -> Column:
    """Two decimals, in millions from a million on."""
    return F.when(F.abs(c) >= 1e6, F.format_string("%.2fM", c / 1e6)).otherwise(fixed(c))


def kpis(df: DataFrame, types: TableTypes, quality_score: float | None = None) -> DataFrame:
    """Up to four rows (position, label, sub_label, value): one aggregate plus the monthly growth."""
    numbers, labels = types.numerical, types.categorical
    first = numeric(numbers[0], field_type(df, numbers[0])) if numbers else F.lit(None).cast("double")
    second = numeric(numbers[1], field_type(df, numbers[1])) if len(numbers) > 1 else F.lit(None).cast("double")
    head = df.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(first), F.lit(0.0)).alias("total"), F.avg(second).alias("mean")
    )
    records = F.format_string("%,d", "rows")
    # fixed values: labels and captions
    entries = [
        (f"Total {numbers[0]}", "Cumulative Aggregation", money(F.col("total")))
        if numbers
        else ("Total Records", "Active Observations", records),
        (f"Average {numbers[1]}", "Mean Observation", fixed("mean"))
        if len(numbers) > 1
        else ("Total Records", "Dataset Volume", records),
        (
            "Data Quality Score",
            "Automated Hygiene",
            F.lit(f"{DEFAULT_QUALITY if quality_score is None else quality_score}%"),
        ),
    ]
    rows = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(a).alias("label"), F.lit(b).alias("sub_label"), v.alias("value"))
        for i, (a, b, v) in enumerate(entries)
    ]
    out = head.select(F.inline(F.array(*rows)))
    fallback = []
    if labels:
        fallback.append((f"Unique {labels[0]}", "Category Segments", str(types.get(labels[0]).unique)))
    if numbers and types.date_column:
        grown = growth(monthly_sums(df, types.time(df), numbers[:1])).where(F.col("growth_pct").isNotNull())
        grown = grown.select(
            F.lit(4).alias("position"),
            F.lit("Net Period Growth").alias("label"),
            F.lit(f"Across {types.date_column}").alias("sub_label"),
            F.format_string("%+,.1f%%", "growth_pct").alias("value"),
        )
        row = grown.first()
        if row is not None:
            fallback = [tuple(row)[1:]]
    if fallback:
        label, sub, value = fallback[0]
        last = small_frame(
            df.sparkSession,
            [{"position": 4, "label": label, "sub_label": sub, "value": value}],
            "position int, label string, sub_label string, value string",
        )
        out = out.unionByName(last)
    return out


def filter_catalogue(df: DataFrame, types: TableTypes) -> DataFrame:
    """One row per slicer: category options, the date range and numeric ranges.

    Only categories already known to have at most 25 values are listed, so every option
    list is short; all ranges share one aggregate.
    """
    ddl = "filter_order int, column string, filter_type string, options array<string>, low string, high string"
    parts = []
    for c in types.categorical:
        if not 1 < types.get(c).unique <= MAX_OPTIONS:
            continue
        options = df.select(col(c).cast("string").alias("o")).where(F.length(F.trim("o")) > 0).distinct()
        parts.append(
            options.agg(F.array_sort(F.collect_list("o")).alias("options")).select(
                F.lit(types.columns.index(types.get(c))).alias("filter_order"),
                F.lit(c).alias("column"),
                F.lit("categorical").alias("filter_type"),
                "options",
                F.lit(None).cast("string").alias("low"),
                F.lit(None).cast("string").alias("high"),
            )
        )
    ranges, aggs, names = [], [], len(types.columns)
    if types.date_column:
        ts = types.time(df)
        aggs += [F.min(ts).alias("lo_d"), F.max(ts).alias("hi_d")]
        ranges.append((names, types.date_column, "date_range", *[F.date_format(x, "yyyy-MM-dd") for x in ("lo_d", "hi_d")]))
    for i, c in enumerate(types.numerical):
        if is_slicer_name(c):
            v = numeric(c, field_type(df, c))
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
            ends = [F.format_string("%.2f", F.round(x, 2)) for x in (f"lo{i}", f"hi{i}")]
            ranges.append((names + 1 + i, c, "numeric_range", *ends))
    if ranges:
        rows = [
            F.struct(
                F.lit(k).alias("filter_order"),
                F.lit(c).alias("column"),
                F.lit(kind).alias("filter_type"),
                F.lit(None).cast("array<string>").alias("options"),
                lo.alias("low"),
                hi.alias("high"),
            )
            for k, c, kind, lo, hi in ranges
        ]
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))).where(F.col("low").isNotNull()))
    return union_all(parts) if parts else small_frame(df.sparkSession, [], ddl)


