"""Semantic column types and the column profile.

The number of Spark jobs does not depend on the number of columns: one wide
aggregate, one job of per-column distinct counts, one for medians, one for the most
frequent values, one for the sample values and one for duplicate rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetlens.functions.counts import distinct_counts, one_row, top_values, union_all
from sheetlens.functions.dates import LAYOUTS, candidate_layouts, date_shaped, parsed_date
from sheetlens.functions.names import is_id_name
from sheetlens.functions.quantiles import exact_quantiles
from sheetlens.functions.values import (
    col,
    comparable,
    event_time,
    field_type,
    fixed,
    half_up,
    is_numeric,
    is_time,
    numeric_frame,
)
from sheetlens.session import small_frame
from sheetlens.sources.row_ids import ROW_ID, data_columns, with_row_id

# Thresholds of the type rules and sizes of the reports.
DATE_HIT_RATE = 0.8
ID_UNIQUE_RATE = 0.9
TEXT_MIN_UNIQUE = 50
TEXT_UNIQUE_RATE = 0.5
TEXT_MIN_LENGTH = 30
TOP_CATEGORIES = 10
SAMPLE_VALUES = 5
CLASSES = ("numerical", "categorical", "datetime", "boolean", "id", "text")
STEP_LIMITS = (("Daily", 2), ("Weekly", 10), ("Monthly", 45))


@dataclass
class ColumnType:
    name: str
    sem_type: str
    storage_type: str
    present: int
    missing: int
    unique: int
    date_format: str | None = None

    def missing_pct(self, rows: int) -> float:
        return half_up(100.0 * self.missing / rows, 2) if rows else 0.0


@dataclass
class TableTypes:
    """Semantic types of one table; a few values per column."""

    rows: int
    columns: list[ColumnType] = field(default_factory=list)
    extra: dict | None = None

    def of(self, sem_type: str) -> list[str]:
        return [c.name for c in self.columns if c.sem_type == sem_type]

    @property
    def numerical(self) -> list[str]:
        return self.of("numerical")

    @property
    def categorical(self) -> list[str]:
        return self.of("categorical")

    @property
    def dates(self) -> list[str]:
        return self.of("datetime")

    @property
    def date_column(self) -> str | None:
        return self.dates[0] if self.dates else None

    @property
    def missing_total(self) -> int:
        return sum(c.missing for c in self.columns)

    def get(self, name: str) -> ColumnType:
        return next(c for c in self.columns if c.name == name)

    def time(self, df: DataFrame, name: str | None = None):
        """The (first) date column as a timestamp expression."""
        name = name or self.date_column
        return event_time(df, name, self.get(name).date_format)


def _first_pass(df: DataFrame, columns: list[str], extra: list[Column], derived: list[Column]) -> dict:
    """Counts, lengths and date shapes of all columns in one aggregate, with the caller's own."""
    types = {c: field_type(df, c) for c in columns}
    df = df.select(*[col(c) for c in columns], *derived)
    aggs = [F.count("*").alias("rows"), *extra]
    for i, c in enumerate(columns):
        t = types[c]
        value = comparable(c, t)
        aggs.append(F.count(value).alias(f"n{i}"))
        if is_numeric(t):
            aggs.append((F.min(value) < F.max(value)).alias(f"varies{i}"))
        if isinstance(t, T.StringType):
            aggs.append(F.avg(F.length(col(c))).alias(f"len{i}"))
            aggs.append(F.count(F.when(date_shaped(col(c)), 1)).alias(f"shaped{i}"))
        elif not is_numeric(t) and not is_time(t) and not isinstance(t, T.BooleanType):
            aggs.append(F.avg(F.length(value.cast("string"))).alias(f"len{i}"))
    return one_row(df, aggs)


def _date_formats(df: DataFrame, columns: list[str], present: list[int]) -> dict[str, str]:
    """Best layout of each column of mostly date-shaped text, if it parses often enough."""
    layouts = candidate_layouts(df, columns)
    tried = [(c, layout) for c in columns for layout in layouts[c]]
    if not tried:
        return {}
    hits = one_row(df, [F.count(parsed_date(col(c), layout)).alias(f"d{k}") for k, (c, layout) in enumerate(tried)])
    out = {}
    for c, n in zip(columns, present, strict=True):
        mine = [(hits[f"d{k}"], -k) for k, (other, _) in enumerate(tried) if other == c]
        if mine and max(mine)[0] >= DATE_HIT_RATE * n:
            out[c] = tried[-max(mine)[1]][1]
    return out


def infer_types(df: DataFrame, unique: str = "labels", extra: tuple[list[Column], list[Column]] = ([], [])) -> TableTypes:
    """Class of every column: one aggregate, one job of distinct counts, one for date-shaped text.

    ``unique`` says which distinct counts are wanted: "all" columns, "labels" (every column that is not a
    plain number or a date), or "needed" (only those a class depends on). Others are reported as -1.
    ``extra`` = (aggregates, columns derived for them) rides along in the same scan.
    """
    columns = data_columns(df)
    kinds = {c: field_type(df, c) for c in columns}
    row = _first_pass(df, columns, *extra)
    out = TableTypes(row["rows"], extra=row)
    texts = [i for i, c in enumerate(columns) if isinstance(kinds[c], T.StringType)]
    maybe = [i for i in texts if row[f"n{i}"] and row[f"shaped{i}"] >= DATE_HIT_RATE * row[f"n{i}"]]
    formats = _date_formats(df, [columns[i] for i in maybe], [row[f"n{i}"] for i in maybe])

    def counted(i: int, c: str) -> bool:
        if unique == "all":
            return True
        plain = is_numeric(kinds[c]) or is_time(kinds[c]) or isinstance(kinds[c], T.BooleanType)
        if is_id_name(c) and not is_time(kinds[c]) and c not in formats:
            return True
        return not plain and c not in formats and (unique == "labels" or (row[f"len{i}"] or 0) > TEXT_MIN_LENGTH)

    seen = distinct_counts(df, [c for i, c in enumerate(columns) if counted(i, c)])
    for i, c in enumerate(columns):
        t, n = kinds[c], seen.get(c, -1)
        present, fmt = row[f"n{i}"], formats.get(c)
        identifier = is_id_name(c) and n >= ID_UNIQUE_RATE * out.rows
        if isinstance(t, T.BooleanType):
            sem = "boolean"
        elif is_numeric(t):
            sem = "id" if identifier else ("numerical" if row[f"varies{i}"] else "categorical")
        elif is_time(t) or fmt:
            sem = "datetime"
        elif identifier:
            sem = "id"
        else:
            many = n > max(TEXT_MIN_UNIQUE, TEXT_UNIQUE_RATE * out.rows)
            sem = "text" if many and (row[f"len{i}"] or 0) > TEXT_MIN_LENGTH else "categorical"
        if sem == "categorical" and n < 0 and is_numeric(t):
            n = int(present > 0)
        out.columns.append(ColumnType(c, sem, t.simpleString(), present, out.rows - present, n, fmt))
    return out


COLUMN_SCHEMA = (
    "col_order int, column string, sem_type string, storage_type string, missing_count bigint, "
    "missing_pct double, unique_count bigint"
)


def column_types(df: DataFrame, types: TableTypes | None = None) -> DataFrame:
    """One row per column: class, missing values, distinct values."""
    types = types or infer_types(df, "all")
    rows = [
        {
            "col_order": i,
            "column": c.name,
            "sem_type": c.sem_type,
            "storage_type": c.storage_type,
            "missing_count": c.missing,
            "missing_pct": c.missing_pct(types.rows),
            "unique_count": c.unique,
        }
        for i, c in enumerate(types.columns)
    ]
    return small_frame(df.sparkSession, rows, COLUMN_SCHEMA)


TABLE_SCHEMA = (
    "row_count bigint, column_count int, missing_values bigint, duplicate_rows bigint, numerical_columns array<string>, "
    "categorical_columns array<string>, date_columns array<string>, boolean_columns array<string>, "
    "id_columns array<string>, text_columns array<string>"
)


def table_profile(df: DataFrame, types: TableTypes | None = None) -> DataFrame:
    """One row per table: size, missing values, copies and the columns of each class."""
    types = types or infer_types(df)
    row = {
        "row_count": types.rows,
        "column_count": len(types.columns),
        "missing_values": types.missing_total,
        "duplicate_rows": duplicate_rows(df).first()[0],
    }
    lists = ("numerical", "categorical", "date", "boolean", "id", "text")
    row |= {f"{name}_columns": types.of(sem) for name, sem in zip(lists, CLASSES)}
    return small_frame(df.sparkSession, [row], TABLE_SCHEMA)


def class_counts(profile: DataFrame) -> DataFrame:
    """Number of columns per class, from ``column_types``."""
    return profile.groupBy("sem_type").agg(F.count("*").alias("column_count"))


STATS_SCHEMA = (
    "column string, mean double, median double, std double, min double, max double, sum double, range string"
)


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, sample standard deviation, min, max, sum per numerical column."""
    nums = numeric_frame(df, columns)
    aggs = []
    for i, c in enumerate(columns):
        v = col(c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.round(F.avg(v), 2).alias(f"mean{i}"),
            F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 2).alias(f"std{i}"),
            F.round(F.min(v), 2).alias(f"min{i}"),
            F.round(F.max(v), 2).alias(f"max{i}"),
            F.round(F.sum(v), 2).alias(f"sum{i}"),
            F.concat(fixed(F.min(v)), F.lit(" – "), fixed(F.max(v))).alias(f"range{i}"),
        ]
    row = one_row(nums, aggs)
    medians = exact_quantiles(nums, columns, [0.5], {c: row[f"n{i}"] for i, c in enumerate(columns)})
    rows = [
        {"column": c, "median": half_up(medians[c][0], 2)}
        | {k: row[f"{k}{i}"] for k in ("mean", "std", "min", "max", "sum", "range")}
        for i, c in enumerate(columns)
        if row[f"n{i}"]
    ]
    return small_frame(df.sparkSession, rows, STATS_SCHEMA)


def top_categories(df: DataFrame, columns: list[str], k: int = TOP_CATEGORIES) -> DataFrame:
    """The most frequent values per column: (column, value, count, rank)."""
    return top_values(df, columns, k).select(
        F.col("col").alias("column"), F.col("val").alias("value"), F.col("cnt").alias("count"), "rank"
    )


def sample_values(df: DataFrame, columns: list[str] | None = None, k: int = SAMPLE_VALUES) -> DataFrame:
    """First present values per column in row order: (column, position, value).

    One top-k per column: each branch reads that column only and keeps k rows per
    partition, so nothing is sorted or shuffled beyond k rows.
    """
    df = with_row_id(df)
    parts = []
    for c in columns or data_columns(df):
        value = comparable(c, field_type(df, c)).cast("string")
        parts.append(
            df.select(F.lit(c).alias("column"), ROW_ID, value.alias("value"))
            .where(F.col("value").isNotNull())
            .orderBy(ROW_ID)
            .limit(k)
        )
    order = Window.partitionBy("column").orderBy(ROW_ID)
    return union_all(parts).select("column", F.row_number().over(order).alias("position"), "value")


def datetime_stats(df: DataFrame, types: TableTypes, columns: list[str] | None = None) -> DataFrame:
    """Range and step size of date columns."""
    columns = columns or types.dates
    aggs = []
    for i, c in enumerate(columns):
        ts = types.time(df, c)
        aggs += [F.min(ts).alias(f"lo{i}"), F.max(ts).alias(f"hi{i}"), F.count(ts).alias(f"n{i}")]
    wide = df.agg(*aggs)
    pieces = [
        F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(columns)
    ]
    days = F.extract(F.lit("DAY"), F.col("hi") - F.col("lo"))
    step = days / F.greatest(F.lit(1), F.col("n") - 1)
    name = F.when(F.col("n") < 2, "Single Date")
    for label, limit in STEP_LIMITS:
        name = name.when(step <= limit, label)
    return (
        wide.select(F.inline(F.array(*pieces)))
        .where(F.col("n") > 0)
        .select(
            "column",
            F.date_format("lo", "yyyy-MM-dd").alias("min"),
            F.date_format("hi", "yyyy-MM-dd").alias("max"),
            F.concat_ws(" to ", F.date_format("lo", "yyyy-MM-dd"), F.date_format("hi", "yyyy-MM-dd")).alias("range"),
            name.otherwise("Yearly").alias("granularity"),
        )
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row; copies collapse map-side before the shuffle."""
    columns = data_columns(df)
    keys = [comparable(c, field_type(df, c)).alias(f"k{i}") for i, c in enumerate(columns)]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def date_detection(df: DataFrame, columns: list[str]) -> DataFrame:
    """Best date layout per text column and the share of values it parses; ties go to the layout listed first."""
    layouts = candidate_layouts(df, columns)
    aggs, pieces = [], []
    for i, c in enumerate(columns):
        aggs.append(F.count(col(c)).alias(f"n{i}"))
        aggs += [F.count(parsed_date(col(c), layout)).alias(f"d{i}_{k}") for k, layout in enumerate(layouts[c])]
        options = [F.struct(F.col(f"d{i}_{k}").alias("hits"), F.lit(-k).alias("pref"), F.lit(x).alias("fmt")) for k, x in enumerate(layouts[c])]
        none = F.struct(F.lit(0).cast("bigint").alias("hits"), F.lit(-len(LAYOUTS)).alias("pref"), F.lit("").alias("fmt"))
        pieces.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("present"), F.array_max(F.array(*options, none)).alias("b")))
    rate = F.try_divide(F.col("b.hits"), F.col("present"))
    found = F.coalesce(rate >= DATE_HIT_RATE, F.lit(False))
    return (
        df.agg(*aggs)
        .select(F.inline(F.array(*pieces)))
        .select(
            "column",
            "present",
            F.col("b.hits").alias("hits"),
            F.round(rate, 4).alias("hit_rate"),
            found.alias("is_date"),
            F.when(found, F.col("b.fmt")).alias("date_format"),
        )
    )
