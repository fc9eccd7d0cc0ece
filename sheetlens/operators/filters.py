"""Row filters, search, paging and the anomaly overlay of the row view."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetlens.functions.values import FRACTION_TYPES, col, field_type, is_numeric, is_time, numeric
from sheetlens.session import stage
from sheetlens.sources.row_ids import ROW_ID, data_columns, position_index, rows_between, with_row_id

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _literal(t: T.DataType, text: str) -> Column | None:
    """A typed literal whose text form is ``text``, or None when the type has no such value."""
    if isinstance(t, INTEGER_TYPES):
        try:
            return F.lit(int(text)) if str(int(text)) == text else None
        except ValueError:
            return None
    if isinstance(t, FRACTION_TYPES):
        try:
            return F.lit(float(text)) if repr(float(text)) == text else None
        except ValueError:
            return None
    if isinstance(t, T.BooleanType):
        return {"True": F.lit(True), "False": F.lit(False)}.get(text)
    return F.lit(text)


def _equals_any(df: DataFrame, name: str, values: list[Any]) -> Column:
    """Equality on the text form, written with typed literals so that it reaches the scan."""
    t = field_type(df, name)
    if is_time(t):
        tests = []
        for v in values:
            text = str(v)
            try:
                start = dt.datetime.fromisoformat(text)
            except ValueError:
                continue  # no time has this text form
            end = start + (dt.timedelta(days=1) if len(text) == 10 else dt.timedelta(microseconds=1))
            tests.append((col(name) >= F.lit(str(start)).cast(t)) & (col(name) < F.lit(str(end)).cast(t)))
        return reduce(or_, tests) if tests else F.lit(False)
    literals = [x for x in (_literal(t, str(v)) for v in values) if x is not None]
    return col(name).isin(*literals) if literals else F.lit(False)


def apply_filters(df: DataFrame, active: dict[str, Any] | None) -> DataFrame:
    """Keep rows that satisfy every filter: a value, a list of values, or {"min", "max"}.

    Unknown columns, None, "all" and empty lists do not filter.
    """
    for name, wanted in (active or {}).items():
        if name not in df.columns or wanted is None or wanted == "all" or wanted == []:
            continue
        if isinstance(wanted, dict):
            value = col(name) if is_numeric(field_type(df, name)) else numeric(name, field_type(df, name))
            for key, test in (("min", value.__ge__), ("max", value.__le__)):
                if wanted.get(key) is not None:
                    df = df.where(test(F.lit(float(wanted[key]))))
        else:
            df = df.where(_equals_any(df, name, wanted if isinstance(wanted, list) else [wanted]))
    return df


def has_filters(active: dict[str, Any] | None) -> bool:
    return any(v not in (None, "all", [], {}) for v in (active or {}).values())


def filter_status(df: DataFrame, active: dict[str, Any] | None) -> DataFrame:
    """(has_filters, active_rows, suffix) for the filtered table."""
    on = has_filters(active)
    # fixed value: the note added to answers over filtered rows
    note = F.format_string(" (%,d records after active filters)", "active_rows") if on else F.lit("")
    return (
        apply_filters(df, active)
        .agg(F.count("*").alias("active_rows"))
        .select(F.lit(on).alias("has_filters"), "active_rows", note.alias("suffix"))
    )


def apply_slicers(df: DataFrame, active: dict[str, Any]) -> DataFrame:
    """Dashboard slicers: two-element lists are ranges, text compares trimmed and case-free.

    A range is one of whole days when either end is a text that holds "-" after its first sign; an end may be left open.
    """
    for name, wanted in active.items():
        if wanted in (None, "", "All") or name not in df.columns:
            continue
        t = field_type(df, name)
        if isinstance(wanted, (list, tuple)) and len(wanted) == 2:
            low, high = wanted
            if any(isinstance(end, str) and "-" in end[1:] for end in (low, high)):
                tests = []
                if is_time(t):
                    # whole days as a half-open range of the stored type, so that it is pushed down
                    if low:
                        tests.append(col(name) >= F.lit(str(dt.datetime.fromisoformat(low))).cast(t))
                    if high:
                        end = dt.datetime.fromisoformat(high) + dt.timedelta(days=1)
                        tests.append(col(name) < F.lit(str(end)).cast(t))
                else:
                    day = F.substring(F.coalesce(col(name).cast("string"), F.lit("")), 1, 10)
                    if low:
                        tests.append(day >= F.lit(low))
                    if high:
                        tests.append(day <= F.lit(high))
            else:
                value = col(name) if is_numeric(t) else numeric(name, t)
                tests = [value.isNotNull()]
                if low not in (None, ""):
                    tests.append(value >= F.lit(float(low)))
                if high not in (None, ""):
                    tests.append(value <= F.lit(float(high)))
            df = df.where(reduce(and_, tests)) if tests else df
        elif isinstance(wanted, str):
            shown = F.lower(F.trim(F.coalesce(col(name).cast("string"), F.lit(""))))
            df = df.where(shown == F.lower(F.trim(F.lit(wanted))))
    return df


def search_rows(df: DataFrame, needle: str) -> DataFrame:
    """Rows where any column's text holds the needle, ignoring case; no pattern syntax."""
    wanted = F.lit(needle.lower())
    hits = [F.coalesce(F.contains(F.lower(col(c).cast("string")), wanted), F.lit(False)) for c in data_columns(df)]
    return df.where(reduce(or_, hits))


def display(df: DataFrame) -> DataFrame:
    """Every column as text, missing values as empty text."""
    keep = [F.col(ROW_ID)] if ROW_ID in df.columns else []
    return df.select(*keep, *[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in data_columns(df)])


def page_rows(df: DataFrame, page: int = 1, page_size: int = 50, search: str = "", dense_ids: bool = False) -> DataFrame:
    """One page in row order, ready to show.

    Row ids known to run from 0 without gaps (one Parquet file) make an unfiltered page a range
    filter without any sort, however deep; otherwise the page is a top-k by row id.
    """
    rows = with_row_id(df)
    start = max(0, (page - 1) * page_size)
    if search:
        rows = search_rows(rows, search)
    elif dense_ids:
        return display(rows.where((F.col(ROW_ID) >= start) & (F.col(ROW_ID) < start + page_size)))
    return display(rows.orderBy(ROW_ID).offset(start).limit(page_size))


def page_index(df: DataFrame, search: str = "") -> DataFrame:
    """Positions of the rows (or of the hits of a search) by blocks, written once for all pages of a table."""
    return stage(position_index(search_rows(df, search).select(ROW_ID) if search else df.select(ROW_ID)), "pages")


def page_at(df: DataFrame, index: DataFrame, page: int | None = None, page_size: int = 50, search: str = "") -> DataFrame:
    """A page in any depth, the last one if ``page`` is None: rows of the blocks it lies in, without a sort of those before.

    ``df`` carries row ids and ``index`` comes from ``page_index`` of the same table and search.
    """
    if page is None:
        rows = index.agg(F.sum("n")).first()[0] or 0
        page = max(1, -(-rows // page_size))
    first = max(0, (page - 1) * page_size)
    return display(rows_between(search_rows(df, search) if search else df, index, first, first + page_size))


def anomaly_overlay(page: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of a page, each with its first anomaly record, if any.

    Both sides carry the row id, so no positions are needed; both are a few rows long.
    """
    first = F.min(F.struct("record", "column", "method", "anomaly_score"))
    marks = records.groupBy(F.col("row_id").alias(ROW_ID)).agg(first.alias("m"))
    return page.join(marks, ROW_ID, "left").select(
        page["*"],
        F.col("m.column").alias("anomaly_column"),
        F.col("m.method").alias("anomaly_method"),
        F.col("m.anomaly_score").alias("anomaly_score"),
    )
