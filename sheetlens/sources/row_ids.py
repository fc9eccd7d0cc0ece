"""Row identity: an id per input row, and dense 1-based positions after cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_ID = "_row_id"
FILE_STRIDE_BITS = 40
BLOCK_BITS = 18
#: monotonically_increasing_id counts the rows of a task in these bits.
SPLIT_ROW_BITS = 33


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def _ranked(places: DataFrame, *by: str) -> DataFrame:
    """Distinct rows of ``places`` with their rank; one row per file or split, far fewer than the table has rows."""
    return places.distinct().withColumn("_pos", F.row_number().over(Window.orderBy(*by)).cast("bigint") - 1)


def read_parquet(spark, path: str) -> DataFrame:
    """Parquet rows with ``_row_id`` = (rank of the file by path, row in file), whatever the number of files.

    The ranks come from a scan that reads no data column, and are joined by file path.
    """
    df = spark.read.parquet(path)
    files = df.select(F.col("_metadata.file_path").alias("_file"))
    if files.distinct().limit(2).count() <= 1:
        return df.select("*", F.col("_metadata.row_index").alias(ROW_ID))
    with_file = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return (
        with_file.join(_ranked(files, "_file"), "_file")
        .withColumn(ROW_ID, F.shiftleft("_pos", FILE_STRIDE_BITS) + F.col("_at"))
        .drop("_file", "_pos", "_at")
    )


def number_text_rows(df: DataFrame) -> DataFrame:
    """Rows of a text source that carry ``_file``, ``_from`` (start of their split) and ``_at`` (a number that rises
    inside the split), with ``_row_id`` = (rank of the split by path and start, row in split)."""
    splits = _ranked(df.select("_file", "_from"), "_file", "_from")
    inside = F.col("_at").bitwiseAND(F.lit((1 << SPLIT_ROW_BITS) - 1))
    return df.join(splits, ["_file", "_from"]).withColumn(ROW_ID, F.shiftleft("_pos", SPLIT_ROW_BITS) + inside).drop("_file", "_from", "_pos", "_at")


def with_row_id(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Add ``_row_id`` from a unique key, or from the partition order of ``df``."""
    if ROW_ID in df.columns:
        return df
    return df.withColumn(ROW_ID, F.monotonically_increasing_id() if key is None else key.cast("bigint"))


def with_positions(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Dense 1-based position by ``_row_id``, without a global sort or window.

    Ids fall into blocks of at most 2**18; a window numbers the rows inside a block
    and the block starts come from the (tiny) table of block counts.
    """
    block = F.shiftright(F.col(ROW_ID), BLOCK_BITS)
    blocked = df.withColumn("_block", block)
    counts = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_block").orderBy(ROW_ID)
    return (
        blocked.withColumn("_in_block", F.row_number().over(inside))
        .join(starts, "_block")
        .withColumn(name, F.col("_start") + F.col("_in_block"))
        .drop("_block", "_in_block", "_start")
    )


#: Rows of a page come from blocks of 2**12 ids; starts of blocks are added up in groups of 2**12 blocks.
PAGE_BLOCK_BITS = GROUP_BITS = 12


def position_index(df: DataFrame) -> DataFrame:
    """(block, n, start): the rows of ``df`` in every block of row ids, and how many rows come before it.

    Reads nothing but what ``_row_id`` and the filters of ``df`` need. Starts inside a group of blocks come from a window
    over the group, those of the groups from one over a 4,096th of the blocks.
    """
    counts = df.groupBy(F.shiftright(ROW_ID, PAGE_BLOCK_BITS).alias("block")).agg(F.count("*").alias("n"))
    grouped = counts.withColumn("_group", F.shiftright("block", GROUP_BITS))
    earlier = (Window.unboundedPreceding, -1)
    groups = grouped.groupBy("_group").agg(F.sum("n").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_group").rowsBetween(*earlier)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_group").orderBy("block").rowsBetween(*earlier)), F.lit(0))
    starts = groups.select("_group", before.alias("_before"))
    return grouped.join(starts, "_group").select("block", "n", (F.col("_before") + inside).alias("start"))


def rows_between(df: DataFrame, index: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of ``df`` at the positions ``first`` to ``last`` - 1 (from 0), with ``index`` from ``position_index``.

    Only the blocks of these positions pass the scan's filter; a window over each of them gives the positions.
    """
    wanted = index.where((F.col("start") < last) & (F.col("start") + F.col("n") > first))
    ends = wanted.agg(F.min("block").alias("low"), F.max("block").alias("high")).first()
    if ends["low"] is None:
        return df.limit(0)
    low, high = ends["low"] << PAGE_BLOCK_BITS, (ends["high"] + 1) << PAGE_BLOCK_BITS
    near = df.where((F.col(ROW_ID) >= low) & (F.col(ROW_ID) < high)).withColumn("_block", F.shiftright(ROW_ID, PAGE_BLOCK_BITS))
    starts = wanted.select(F.col("block").alias("_block"), F.col("start").alias("_start"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_block").orderBy(ROW_ID)) - 1
    return near.join(starts, "_block").withColumn("_place", place).where((F.col("_place") >= first) & (F.col("_place") < last)).drop("_block", "_start", "_place")
