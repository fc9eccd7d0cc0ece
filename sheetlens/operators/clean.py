"""Type-aware cleaning with a report of every change.

Order: numeric text to numbers, tidy categories, drop repeated rows, fill missing values,
drop rows that became equal, count outliers, score. The table is written once after the first
drop and once at the end; decisions come from one aggregate per step over all columns. Whole
rows are shuffled for the first drop only: the second one looks at hashes of the rows that a
filled value can have made equal, and compares whole rows where hashes agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetlens.functions.counts import modes
from sheetlens.functions.names import is_id_name
from sheetlens.functions.quantiles import exact_quantiles
from sheetlens.functions.values import (
    FRACTION_TYPES,
    bare_is_percent,
    bare_looks_numeric,
    bare_number,
    bare_value,
    col,
    collapse_spaces,
    comparable,
    field_type,
    half_up,
    looks_like_word,
    number_from_text,
    numeric_frame,
    title_case,
)
from sheetlens.operators.anomaly import outlier_bounds
from sheetlens.operators.profile import ColumnType, TableTypes, infer_types
from sheetlens.session import drop_staged, small_frame, stage
from sheetlens.sources.row_ids import ROW_ID, data_columns, with_row_id

# Thresholds, weights and wording of the report.
NUMERIC_HIT_RATE, WORD_RATE = 0.9, 0.8
FIXED_COST, NORMALISED_COST, CONSISTENCY_FLOOR = 2.0, 1.5, 75.0
WEIGHTS = {"completeness": 0.45, "duplicate_free": 0.35, "consistency": 0.20}
FIXED_NOTE = "converted currency/percentage-formatted text to numeric"
MEDIAN_NOTE, MODE_NOTE = "the column median", "the most common value"
NO_MODE = "Unknown"


@dataclass
class CleanReport:
    rows_before: int = 0
    rows_after: int = 0
    duplicate_rows_removed: int = 0
    missing_values_before: int = 0
    missing_values_after: int = 0
    columns: int = 0
    columns_format_fixed: dict[str, str] = field(default_factory=dict)
    columns_text_normalized: list[str] = field(default_factory=list)
    missing_values_filled: dict[str, dict] = field(default_factory=dict)
    missing_values_left: dict[str, int] = field(default_factory=dict)
    outliers_flagged: int = 0

    def scores(self) -> dict[str, float]:
        """Completeness, duplicate-free, consistency and overall quality, in percent."""
        cells = max(1, self.rows_before * max(1, self.columns))
        raw = {
            "completeness": _percent(1.0 - self.missing_values_before / cells),
            "duplicate_free": _percent(1.0 - self.duplicate_rows_removed / max(1, self.rows_before)),
            "consistency": max(
                CONSISTENCY_FLOOR,
                100.0
                - FIXED_COST * len(self.columns_format_fixed)
                - NORMALISED_COST * len(self.columns_text_normalized),
            ),
        }
        overall = sum(w * raw[k] for k, w in WEIGHTS.items())
        return {f"{k}_score": half_up(v, 1) for k, v in raw.items()} | {"quality_score": half_up(overall, 1)}


def _percent(share: float) -> float:
    return max(0.0, min(100.0, share * 100.0))


REPORT_DDL = (
    "rows_before bigint, rows_after bigint, duplicate_rows_removed bigint, missing_values_before bigint, "
    "missing_values_after bigint, columns_format_fixed map<string,string>, columns_text_normalized array<string>, "
    "missing_values_filled map<string,struct<count:bigint,strategy:string,fill_value:string>>, "
    "missing_values_left map<string,bigint>, outliers_flagged bigint, quality_score double, "
    "completeness_score double, consistency_score double, duplicate_free_score double"
)


def report_frame(spark, report: CleanReport) -> DataFrame:
    """The report as one row."""
    row = dict(report.__dict__) | report.scores()
    row["missing_values_filled"] = {
        c: {"count": v["count"], "strategy": v["strategy"], "fill_value": str(v["fill_value"])}
        for c, v in report.missing_values_filled.items()
    }
    return small_frame(spark, [row], REPORT_DDL)


def cleaning_log(spark, report: CleanReport) -> DataFrame:
    """The report as readable lines: (line, step, detail)."""
    # fixed values: the sentences of the log
    lines: list[tuple[str, str]] = []
    if report.duplicate_rows_removed:
        lines.append(("duplicates", f"✓ Removed {report.duplicate_rows_removed} exact duplicate row(s)."))
    for c, what in report.columns_format_fixed.items():
        lines.append(("format", f"✓ '{c}': {what}."))
    if report.columns_text_normalized:
        names = ", ".join(f"'{c}'" for c in report.columns_text_normalized)
        lines.append(("text", f"✓ Normalized inconsistent text casing/whitespace in {names}."))
    for c, fill in report.missing_values_filled.items():
        detail = f"✓ '{c}': imputed {fill['count']} missing value(s) with {fill['strategy']} ({fill['fill_value']})."
        lines.append(("fill", detail))
    if report.missing_values_left:
        names = ", ".join(f"'{c}' ({n})" for c, n in report.missing_values_left.items())
        lines.append(("left", f"• Preserved missing values as-is in {names} (identifiers/free text/dates)."))
    if report.outliers_flagged:
        lines.append(("outliers", f"⚠ {report.outliers_flagged} statistical outlier(s) flagged for review."))
    if not lines:
        lines.append(("none", "✓ No cleaning was necessary -- dataset passed all hygiene checks."))
    rows = [{"line": i + 1, "step": step, "detail": text} for i, (step, text) in enumerate(lines)]
    return small_frame(spark, rows, "line int, step string, detail string")


def _text_columns(df: DataFrame, types: TableTypes, classes: tuple[str, ...]) -> list[str]:
    return [c.name for c in types.columns if c.sem_type in classes and isinstance(field_type(df, c.name), T.StringType)]


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def _number_aggs(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """Per text column: number-like values, percents, convertible values, and whether those vary.

    The bare text is a derived column, so that it is computed once per value.
    """
    aggs, derived = [], []
    for c in data_columns(df):
        if isinstance(field_type(df, c), T.StringType):
            derived += [bare_number(col(c)).alias(f"bare:{c}"), bare_value(bare_number(col(c))).alias(f"value:{c}")]
            bare, value = col(f"bare:{c}"), col(f"value:{c}")
            aggs += [
                F.count(F.when(bare_looks_numeric(bare), 1)).alias(f"hits:{c}"),
                F.count(F.when(bare_is_percent(bare), 1)).alias(f"percents:{c}"),
                F.count(value).alias(f"numbers:{c}"),
                (F.min(value) < F.max(value)).alias(f"varies:{c}"),
            ]
    return aggs, derived


def typed_for_cleaning(df: DataFrame) -> TableTypes:
    """Column classes, with what number coercion needs to know from the same scan."""
    return infer_types(df, "needed", _number_aggs(df))


def coerce_numbers(df: DataFrame, types: TableTypes) -> tuple[DataFrame, TableTypes, list[str]]:
    """Turn text columns that are numbers in disguise into doubles, and adapt their classes.

    One "%" anywhere in a column divides the whole column by 100. ``types`` comes from
    ``typed_for_cleaning``.
    """
    seen, new, columns = types.extra, {}, []
    for c in types.columns:
        candidate = c.sem_type in ("categorical", "text") and isinstance(field_type(df, c.name), T.StringType)
        if not candidate or not c.present or seen[f"hits:{c.name}"] < NUMERIC_HIT_RATE * c.present:
            columns.append(c)
            continue
        new[c.name] = number_from_text(col(c.name), seen[f"percents:{c.name}"] > 0)
        present = seen[f"numbers:{c.name}"]
        sem = "numerical" if seen[f"varies:{c.name}"] else "categorical"
        columns.append(ColumnType(c.name, sem, "double", present, types.rows - present, c.unique))
    if not new:
        return df, types, []
    df = _replace(df, new)
    named_ids = [c for c in new if is_id_name(c)]
    if named_ids:
        again = {c.name: c for c in infer_types(df.select(*[col(c) for c in named_ids]), "needed").columns}
        columns = [again.get(c.name, c) for c in columns]
    return df, TableTypes(types.rows, columns), list(new)


def _titled(tidy: Column) -> Column:
    return F.when(looks_like_word(tidy), title_case(tidy)).otherwise(tidy)


def normalise_text(df: DataFrame, types: TableTypes) -> tuple[DataFrame, list[str]]:
    """Trim and collapse blanks; title-case word-like values of mostly word-like columns."""
    candidates = _text_columns(df, types, ("categorical",))
    if not candidates:
        return df, []
    tidied = df.select(
        *[col(c) for c in candidates], *[collapse_spaces(col(c)).alias(f"tidy:{c}") for c in candidates]
    )
    aggs = []
    for i, c in enumerate(candidates):
        tidy = col(f"tidy:{c}")
        aggs += [
            F.count(col(c)).alias(f"n{i}"),
            F.count(F.when(looks_like_word(tidy), 1)).alias(f"w{i}"),
            F.count(F.when(tidy != col(c), 1)).alias(f"s{i}"),
            F.count(F.when(_titled(tidy) != col(c), 1)).alias(f"t{i}"),
        ]
    row = tidied.agg(*aggs).first()
    new = {}
    for i, c in enumerate(candidates):
        wordy = row[f"w{i}"] > WORD_RATE * row[f"n{i}"]
        if row[f"t{i}"] if wordy else row[f"s{i}"]:
            new[c] = _titled(collapse_spaces(col(c))) if wordy else collapse_spaces(col(c))
    return (_replace(df, new) if new else df), list(new)


def _row_keys(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """What equal rows share, by column; maps by their JSON, since they have no order."""
    return {c: comparable(c, field_type(df, c)) if isinstance(field_type(df, c), T.MapType) else col(c) for c in names}


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first of equal rows. Copies collapse map-side, so a row repeated very often is cheap."""
    names = data_columns(df)
    maps = [c for c in names if isinstance(field_type(df, c), T.MapType)]
    if maps:
        keyed = df.withColumns({f"_key_{c}": key for c, key in _row_keys(df, maps).items()})
        keys = [f"_key_{c}" if c in maps else c for c in names]
        aggs = [F.first(col(c)).alias(c) for c in maps]
        grouped = keyed.groupBy(*[col(k) for k in keys]).agg(F.min(ROW_ID).alias(ROW_ID), *aggs)
        return grouped.select(*[col(c) for c in names], ROW_ID)
    return df.groupBy(*[col(c) for c in names]).agg(F.min(ROW_ID).alias(ROW_ID))


_FILLED, _HASH = "_was_filled", "_row_hash"


def impute_and_drop(df: DataFrame, filled: dict[str, dict]) -> tuple[DataFrame, int]:
    """Distinct rows with the fill values put in, the first of those that became equal kept: (rows, number dropped).

    Two rows can only become equal when one had a gap and the other has a gap there or holds the fill value. Hashes of
    such rows are counted (a narrow shuffle); whole rows are compared where a hash comes again and one of its rows was
    filled. All other rows pass by; the dropped ids are taken out by a join that Spark broadcasts when they are few.
    """
    names = data_columns(df)
    gap = reduce(or_, [col(c).isNull() for c in filled])
    after = impute(df.withColumn(_FILLED, gap), filled)
    keys = _row_keys(after, names)
    holds = [col(c) == F.lit(f["value"]).cast(field_type(after, c)) for c, f in filled.items()]
    touched = after.where(reduce(or_, holds)).withColumn(_HASH, F.xxhash64(*[keys[c] for c in names]))
    again = (
        touched.groupBy(_HASH)
        .agg(F.count("*").alias("n"), F.bool_or(_FILLED).alias("any"))
        .where("n > 1 AND any")
        .select(_HASH)
    )
    suspects = stage(touched.join(again, _HASH, "left_semi").drop(_HASH, _FILLED), "suspects")
    kept = drop_duplicates(suspects).select(ROW_ID)
    dropped = stage(suspects.select(ROW_ID).join(kept, ROW_ID, "left_anti"), "dropped")
    drop_staged(suspects)
    count = dropped.count()
    after = after.drop(_FILLED)
    return (after.join(dropped, ROW_ID, "left_anti").select(*[col(c) for c in names], ROW_ID) if count else after), count


def fill_values(df: DataFrame, types: TableTypes) -> tuple[dict[str, dict], dict[str, int]]:
    """What to put in for missing values per column, and what to leave."""
    holes = {c.name: c for c in types.columns if c.missing}
    numbers = [n for n, c in holes.items() if c.sem_type == "numerical"]
    labels = [n for n, c in holes.items() if c.sem_type in ("categorical", "boolean")]
    nums = numeric_frame(df, numbers)
    medians = exact_quantiles(nums, numbers, [0.5], {n: holes[n].present for n in numbers})
    common = modes(df, labels)
    filled, left = {}, {}
    for name, c in holes.items():
        if name in numbers and medians[name][0] is not None:
            filled[name] = {"count": c.missing, "strategy": MEDIAN_NOTE, "value": medians[name][0], "fill_value": half_up(medians[name][0], 3)}
        elif name in labels:
            value = NO_MODE if common[name] is None else common[name]
            filled[name] = {"count": c.missing, "strategy": MODE_NOTE, "value": value, "fill_value": str(value)}
        else:
            left[name] = c.missing
    return filled, left


def impute(df: DataFrame, filled: dict[str, dict]) -> DataFrame:
    """Put the fill values in. Integer columns become doubles only for a fractional median."""
    new = {}
    for name, fill in filled.items():
        t, value = field_type(df, name), fill["value"]
        whole = isinstance(value, float) and value.is_integer() and not isinstance(t, FRACTION_TYPES)
        target = t if whole or not isinstance(value, float) else T.DoubleType()
        if value == NO_MODE and not isinstance(t, T.StringType):
            target = T.StringType()
        new[name] = F.coalesce(col(name).cast(target), F.lit(value).cast(target))
    return _replace(df, new) if new else df


def count_outliers(df: DataFrame, columns: list[str]) -> int:
    """IQR outliers summed over the columns whose quartiles differ."""
    bounds = [b for b in outlier_bounds(df, columns) if b.q3 > b.q1]
    if not bounds:
        return 0
    nums = numeric_frame(df, [b.column for b in bounds])
    row = nums.agg(*[F.count(F.when(b.outside(col(b.column)), 1)).alias(f"o{i}") for i, b in enumerate(bounds)]).first()
    return sum(row)


def clean(df: DataFrame) -> tuple[DataFrame, CleanReport]:
    """Cleaned table (with ``_row_id`` of the kept rows) and its report."""
    df = with_row_id(df)
    types = typed_for_cleaning(df)
    report = CleanReport(rows_before=types.rows, missing_values_before=types.missing_total, columns=len(types.columns))

    df, types, fixed = coerce_numbers(df, types)
    report.columns_format_fixed = {c: FIXED_NOTE for c in fixed}
    df, report.columns_text_normalized = normalise_text(df, types)

    df = stage(drop_duplicates(df), "distinct")
    types = infer_types(df, "needed")
    filled, report.missing_values_left = fill_values(df, types)
    report.missing_values_filled = {c: {k: v for k, v in f.items() if k != "value"} for c, f in filled.items()}
    if filled:
        distinct = df
        df, dropped = impute_and_drop(distinct, filled)
        df = stage(df, "cleaned")
        drop_staged(distinct)
        report.rows_after = types.rows - dropped
    else:
        report.rows_after = types.rows
    report.duplicate_rows_removed = report.rows_before - report.rows_after
    left = list(report.missing_values_left)
    if left:
        gone = df.agg(*[F.count(F.when(col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(left)]).first()
        report.missing_values_after = sum(gone)
    report.outliers_flagged = count_outliers(df, types.numerical)
    return df, report
