"""Distinct values and value counts of many columns in one job.

Each column is grouped on its own, in its own type, and the results are united.
A wide ``count(distinct a), count(distinct b)`` would multiply every row by the
number of columns (Expand) and a long form would turn every value into text; here
each branch scans one column, counts map-side, and only distinct values shuffle.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.functions.values import comparable, field_type


def _one_column(df: DataFrame, name: str) -> DataFrame:
    value = comparable(name, field_type(df, name))
    return df.select(value.alias("val")).where(F.col("val").isNotNull()).groupBy("val").agg(F.count("*").alias("cnt"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


AGGREGATES_PER_JOB = 300


def one_row(df: DataFrame, aggs: list[Column]) -> dict:
    """Results of many aggregates by name.

    One job for all but very wide tables. Those take a few: each reads only the columns of its share.
    """
    out: dict = {}
    for start in range(0, len(aggs), AGGREGATES_PER_JOB):
        out |= df.agg(*aggs[start : start + AGGREGATES_PER_JOB]).first().asDict()
    return out


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact number of distinct present values per column."""
    if not columns:
        return {}
    parts = [
        _one_column(df, c).agg(F.lit(i).alias("i"), F.count("*").alias("n")) for i, c in enumerate(columns)
    ]
    return {columns[r["i"]]: r["n"] for r in union_all(parts).collect()}


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent values per column: (col_order, col, val, cnt, rank)."""
    parts = []
    for i, c in enumerate(columns):
        part = (
            _one_column(df, c)
            .select(F.lit(i).alias("col_order"), F.lit(c).alias("col"), F.col("val").cast("string").alias("val"), "cnt")
            .orderBy(F.desc("cnt"), F.asc("val"))
            .limit(k)
        )
        parts.append(part)
    ranked = Window.partitionBy("col_order").orderBy(F.desc("cnt"), F.asc("val"))
    return union_all(parts).withColumn("rank", F.row_number().over(ranked))


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties; None when all missing.

    The pick is a constant-size aggregate over the counted values, so a column with
    very many values never ends up in one task's hash map.
    """
    if not columns:
        return {}
    parts = []
    for i, c in enumerate(columns):
        counted = _one_column(df, c).select(F.struct((-F.col("cnt")).alias("neg"), "val").alias("s"))
        parts.append(counted.agg(F.lit(i).alias("i"), F.to_json(F.min("s")).alias("best")))
    rows = {r["i"]: r["best"] for r in union_all(parts).collect()}
    return {c: (json.loads(rows[i]).get("val") if rows.get(i) else None) for i, c in enumerate(columns)}
