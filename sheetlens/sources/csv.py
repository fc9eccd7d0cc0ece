"""CSV ingestion: encoding, header, missing tokens, types, empty rows and columns."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetlens.functions.values import col, parse_double
from sheetlens.sources.records import csv_records
from sheetlens.sources.row_ids import ROW_ID, number_text_rows, read_parquet, with_row_id

# Accepted files and texts that mean "missing".
EXTENSIONS = (".csv", ".parquet")
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TOKENS, FALSE_TOKENS = ("True", "TRUE", "true"), ("False", "FALSE", "false")
INTEGER_PATTERN = r"^\s*[+-]?\d{1,38}\s*$"
BROKEN_CHARACTER = "�"


class IngestError(ValueError):
    """A file that cannot become a table."""


def check_extension(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/").lower())[1]
    if ext not in EXTENSIONS:
        raise IngestError(f"Unsupported file type '{ext}'. Use one of {', '.join(EXTENSIONS)}.")
    return ext


def header_names(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """Trimmed names of the first line; blank ones get a number, repeated ones a suffix."""
    options = {"encoding": encoding, "header": "false", "inferSchema": "false", "quote": '"', "escape": '"', "multiLine": "true"}
    first = spark.read.options(**options).csv(path).limit(1).collect()
    if not first:
        raise IngestError("The file is empty.")
    out, seen = [], {}
    for i, raw in enumerate(first[0]):
        name = (raw or "").lstrip("﻿") or f"Unnamed: {i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    return [n.strip() for n in out]


def _read_text(records: DataFrame, names: list[str], encoding: str) -> DataFrame:
    """Values of ``csv_records`` as text, without the header of each file and empty lines."""
    raw = F.col("record").cast("string")
    # lines of files with Windows line ends keep their carriage return
    text = F.rtrim(F.make_valid_utf8(raw) if encoding == "UTF-8" else F.decode("record", encoding), F.lit("\r"))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records.where((F.col("_from") + F.col("_at") > 0) & (F.length(F.rtrim(raw, F.lit("\r"))) > 0))
    parsed = rows.select(F.from_csv(text, F.lit(schema), {"quote": '"', "escape": '"'}).alias("v"), *PLACE)
    present = [F.when(~F.coalesce(F.col(f"v.c{i}"), F.lit("")).isin(*NA_TOKENS), F.col(f"v.c{i}")).alias(n) for i, n in enumerate(names)]
    return parsed.select(*present, *PLACE)


PLACE = ("_file", "_from", "_at")


def _typed(c: str, rows: int, ints: int, digits: int, nums: int, flags: int) -> Column:
    """A text column in the narrowest type all its present values fit."""
    if rows and flags == rows:
        return col(c).isin(*TRUE_TOKENS)
    if rows and ints == rows:
        return F.trim(col(c)).cast("bigint")
    if rows and digits == rows:
        return F.trim(col(c)).cast("decimal(38,0)")
    if rows and nums == rows:
        return parse_double(col(c))
    return col(c)


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Typed table with ``_row_id``; all-missing columns and rows are left out.

    Files are read in byte ranges by all cores, quoted line breaks or not. Read as UTF-8, and again as Latin-1 if any value holds an undecodable byte. One aggregate over
    all columns decides encoding, types and empty columns.
    """
    check_extension(path)
    records = csv_records(spark, path)
    for encoding in ("UTF-8", "ISO-8859-1"):
        df = _read_text(records, header_names(spark, path, encoding), encoding)
        aggs = [F.count("*").alias("rows")]
        names = [c for c in df.columns if c not in PLACE]
        for i, c in enumerate(names):
            v = col(c)
            whole = F.when(v.rlike(INTEGER_PATTERN), F.trim(v))
            aggs += [
                F.count(v).alias(f"n{i}"),
                F.count(whole.try_cast("bigint")).alias(f"i{i}"),
                F.count(whole.try_cast("decimal(38,0)")).alias(f"w{i}"),
                F.count(parse_double(v)).alias(f"d{i}"),
                F.count(F.when(v.isin(*TRUE_TOKENS, *FALSE_TOKENS), 1)).alias(f"b{i}"),
                F.count(F.when(F.contains(v, F.lit(BROKEN_CHARACTER)), 1)).alias(f"x{i}"),
            ]
        row = df.agg(*aggs).first()
        if encoding != "UTF-8" or not any(row[f"x{i}"] for i in range(len(names))):
            break
    check_size(row["rows"], len(names), max_rows)
    kept = [(i, c) for i, c in enumerate(names) if row[f"n{i}"]]
    typed = [_typed(c, row[f"n{i}"], row[f"i{i}"], row[f"w{i}"], row[f"d{i}"], row[f"b{i}"]).alias(c) for i, c in kept]
    names = [c for _, c in kept]
    any_present = F.coalesce(*[col(n) for n in names]).isNotNull()
    return number_text_rows(df.select(*[col(n) for n in names], *PLACE)).where(any_present).select(*typed, ROW_ID)


def check_size(rows: int, columns: int, max_rows: int | None) -> None:
    if rows == 0 or columns == 0:
        raise IngestError("Dataset contains no usable rows/columns.")
    if max_rows is not None and rows > max_rows:
        raise IngestError(f"Dataset has {rows} rows, exceeding the {max_rows} row limit.")


def drop_empty(df: DataFrame) -> DataFrame:
    """Leave out all-missing columns and rows; trim the names."""
    df = with_row_id(df)
    names = [c for c in df.columns if c != ROW_ID]
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    kept = [c for i, c in enumerate(names) if row[f"n{i}"]]
    rows = df.where(F.coalesce(*[col(c).cast("string") for c in kept]).isNotNull()) if kept else df.limit(0)
    return rows.select(*[col(c).alias(c.strip()) for c in kept], ROW_ID)


def ingest(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """CSV or Parquet as a clean-edged table with row ids."""
    if check_extension(path) == ".csv":
        return read_csv(spark, path, max_rows)
    df = read_parquet(spark, path)
    check_size(df.count() if max_rows is not None else (0 if df.isEmpty() else 1), len(df.columns) - 1, max_rows)
    return drop_empty(df)
