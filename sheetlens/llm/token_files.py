"""Token ids in Parquet list columns, in document order, readable in parts.

One row per document: ``doc_id``, ``part`` and ``start_in_part`` (its place among the ids of its file part), ``n_tokens``
and ``ids``. Ids are dictionary-coded; ids and numbers that outgrow the dictionary fall back to delta coding (writer
version 2). Row groups have a set size and pages carry column and offset indexes, so a filter on ``doc_id`` reads only
the row groups and pages that hold it, and a reader of the other columns never touches the ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetlens.llm.encoding import encoder
from sheetlens.llm.texts import as_texts, chunks
from sheetlens.session import new_path, ship_package

FILE_COLUMNS = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10


def _encode(tokenizer_path: str, end_id: int):
    def run(batches):
        tool = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        before = 0
        for batch in batches:
            for at, texts in chunks(as_texts(batch.column("text"))):
                ids, bounds = tool.encode(texts, end_id)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(bounds[:-1] + before),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32))),
                    ],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                before += int(bounds[-1])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0) -> None:
    """Write the ids of every document in ascending ``doc_id`` order (null ids first, equal ids by a hash of the text).

    Documents are dealt out by ranges of (doc_id, hash), so rows that share a doc_id can be spread as well. A null text
    is an empty text: its only id is ``end_id``. A task that runs again writes the same rows.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    (
        ordered.mapInArrow(_encode(tokenizer_path, end_id), FILE_COLUMNS)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with ``start``, the number of ids of all documents before; prune columns and rows as usual."""
    rows = spark.read.schema(FILE_COLUMNS).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    # one row per written part; parts are in order of doc_id
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("first") + F.col("start_in_part")).drop("first")


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids")
        bounds = ids.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<u4", copy=False))).cast("B")
        crc = np.fromiter((zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:])), np.int64, len(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc)],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the documents' ids, read the files back, and return doc_id, start, n_tokens and ids_crc32 from them.

    One row per input row, repeated rows included; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_token_files(docs, tokenizer_path, path, end_id)
    rows = read_tokens(spark, path).select("doc_id", "start", "ids")
    return rows.mapInArrow(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
