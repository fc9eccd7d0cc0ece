"""Corpus preparation from raw documents to packed sequences; every stage is one operator of ``sheetlens.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the columns
of ``documents``; clean documents pass unchanged. Rows without doc_id pass all filters, since no decision can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.llm.decontaminate import find_leaks, question_and_answer
from sheetlens.llm.ngram_join import ngram_jaccard_join
from sheetlens.llm.packing import pack_documents
from sheetlens.llm.quality import score_quality
from sheetlens.llm.secrets import redact_secrets
from sheetlens.session import drop_staged, stage


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``."""
    return docs.join(ids.select(F.col("doc_id").alias("_dropped")).distinct(), F.col("doc_id") == F.col("_dropped"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote accepts."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 0"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their 5-word shingles, the one with the smallest doc_id."""
    joined = ngram_jaccard_join(docs, n=5, num=80, den=100)
    return _without(docs, joined.where("component_id <> doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    items = question_and_answer(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, find_leaks(docs, items))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text and ``n_chars`` brought up to date."""
    length = F.char_length("text").cast("bigint")
    cleaned = redact_secrets(docs.withColumn("_before", length))
    return cleaned.withColumn("n_chars", F.when(length != F.col("_before"), length).otherwise(F.col("n_chars"))).drop("_before")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Vectors, models and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
        if last is not None:
            drop_staged(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
