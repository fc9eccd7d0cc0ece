"""Per-row value expressions: numeric coercion, text tidying, date parsing."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetlens.functions.dates import parsed_date
from sheetlens.functions.names import quoted

# Symbols and patterns that decide what counts as a number or a word.
CURRENCY_SYMBOLS = "$€£¥₹"
NUMBER_PATTERN = r"^[+-]?\d*\.?\d+$"
WORD_PATTERN = r"^[A-Za-z][A-Za-z\s\-]*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTION_TYPES = (T.FloatType, T.DoubleType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(name: str) -> Column:
    return F.col(quoted(name))


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC_TYPES)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, TIME_TYPES)


def present(name: str, t: T.DataType) -> Column:
    """The value with NaN read as missing."""
    c = col(name)
    return F.nullif(c, F.lit(float("nan")).cast(t)) if isinstance(t, FRACTION_TYPES) else c


def comparable(name: str, t: T.DataType) -> Column:
    """A form that can be grouped on: nested values by their JSON, others as they are."""
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(col(name).alias("v")))
    return present(name, t)


def parse_double(text: Column) -> Column:
    """Text as a double, NULL where it is none.

    A failed cast costs an exception inside the JVM, so text without a digit is not tried.
    """
    return F.when(text.rlike("[0-9]"), F.nullif(text.try_cast("double"), F.lit(float("nan"))))


def numeric(name: str, t: T.DataType) -> Column:
    """Value as double, NULL where it is not a number."""
    if isinstance(t, T.DoubleType):
        return present(name, t)
    if is_numeric(t):
        return present(name, t).cast("double")
    if isinstance(t, T.BooleanType):
        return col(name).cast("int").cast("double")
    if not isinstance(t, T.StringType):
        return F.lit(None).cast("double")
    return parse_double(col(name))


def numeric_frame(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Only the wanted columns, the measured ones as doubles."""
    return df.select(
        *[col(k) for k in (keep or [])],
        *[numeric(c, field_type(df, c)).alias(c) for c in columns],
    )


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


def bare_number(c: Column) -> Column:
    """Text without currency symbols and thousands commas."""
    return F.translate(strip(c), CURRENCY_SYMBOLS + ",", "")


def bare_is_percent(bare: Column) -> Column:
    return F.endswith(bare, F.lit("%"))


def bare_looks_numeric(bare: Column) -> Column:
    return F.rtrim(bare, F.lit("%")).rlike(NUMBER_PATTERN)


def bare_value(bare: Column) -> Column:
    return parse_double(F.translate(bare, "%", ""))


def number_from_text(c: Column, percent: bool) -> Column:
    """Numeric value of formatted text; a percent column is scaled as a whole."""
    value = bare_value(bare_number(c))
    return value / F.lit(100.0) if percent else value


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def looks_like_word(tidy: Column) -> Column:
    return tidy.rlike(WORD_PATTERN)


def title_case(tidy: Column) -> Column:
    """Upper-case first letters after blanks and hyphens alike."""
    hyphened = F.array_join(F.transform(F.split(tidy, "(?<=-)"), F.initcap), "")
    return F.when(F.contains(tidy, F.lit("-")), hyphened).otherwise(F.initcap(tidy))


def event_time(df: DataFrame, name: str, fmt: str | None = None) -> Column:
    """A date column as ``timestamp_ntz``, parsed when it is stored as text."""
    if is_time(field_type(df, name)):
        return col(name).cast("timestamp_ntz")
    if fmt is None:
        raise ValueError(f"text column {name!r} needs a date format")
    return parsed_date(col(name), fmt)


def period_start(ts: Column, unit: str) -> Column:
    """First day of the year, month or day, as a date."""
    return F.to_date(ts) if unit == "day" else F.trunc(F.to_date(ts), unit)


def half_up(x: float | None, digits: int) -> float | None:
    """Round as Spark's ``round`` does, for values finished on the driver."""
    if x is None:
        return None
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def fixed(c: Column | str, digits: int = 2) -> Column:
    """Thousands commas and a fixed number of decimals, rounded on the exact binary value."""
    return F.format_number(c, digits)


def grouped_number(c: Column) -> Column:
    """Thousands commas and one or two decimals, as short as the value allows."""
    return F.regexp_replace(F.format_string("%,.2f", c), "0$", "")


def longform(df: DataFrame, columns: list[str], key: str = "col", value: str = "val") -> DataFrame:
    """Wide one-type columns to (key, value) rows; meant for small aggregates."""
    pairs = [F.struct(F.lit(c).alias(key), col(c).alias(value)) for c in columns]
    keep = [col(c) for c in df.columns if c not in set(columns)]
    return df.select(*keep, F.inline(F.array(*pairs)))
