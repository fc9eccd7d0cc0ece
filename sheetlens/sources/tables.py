"""Cleaned tables and result tables in a folder of Parquet tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.functions.values import col, field_type, is_time
from sheetlens.operators.clean import CleanReport
from sheetlens.operators.profile import TableTypes
from sheetlens.session import drop_folder, make_folder, path_exists, publish_once, small_frame
from sheetlens.sources.row_ids import ROW_ID

# Fixed value: length of the dataset list.
LIST_LENGTH = 50

DATASET_DDL = (
    "dataset_id string, owner string, filename string, row_count bigint, column_count int, numerical_columns int, "
    "categorical_columns int, date_columns int, missing_values bigint, duplicate_rows bigint, dataset_domain string, "
    "quality_score double, created_at timestamp"
)
VERSION_LOG_DDL = "commit bigint, write string, run string"


def save_cleaned(df: DataFrame, path: str) -> DataFrame:
    """Write the typed cleaned table and return it as read back."""
    df.write.mode("errorifexists").parquet(path)
    return load(df.sparkSession, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved table with its schema and row ids; nothing is inferred again."""
    return spark.read.parquet(path)


def export_csv(df: DataFrame, folder: str, filename: str) -> str:
    """Download form: a folder of CSV parts named after the original file; values keep their blanks.

    Times are written as days where a column holds whole days only, else with seconds (and a fraction where one has it).
    """
    out = f"{folder.rstrip('/')}/cleaned_{filename}"
    rows = df.drop(ROW_ID)
    times = [c for c in rows.columns if is_time(field_type(rows, c))]
    if times:
        day = [F.bool_and(F.date_trunc("day", col(c)) == col(c).cast("timestamp")).alias(f"d{i}") for i, c in enumerate(times)]
        second = [F.bool_and(F.date_trunc("second", col(c)) == col(c).cast("timestamp")).alias(f"s{i}") for i, c in enumerate(times)]
        whole = rows.agg(*day, *second).first()
        for i, c in enumerate(times):
            layout = "yyyy-MM-dd" if whole[f"d{i}"] else "yyyy-MM-dd HH:mm:ss" if whole[f"s{i}"] else "yyyy-MM-dd HH:mm:ss.SSSSSS"
            rows = rows.withColumn(c, F.date_format(col(c), layout))
    keep = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("errorifexists").options(**keep).csv(out)
    return out


def append_result(result: DataFrame, base: str, kind: str, dataset_id: str) -> None:
    """Store one analysis result table; partitions keep datasets apart, and a repeated run replaces its own."""
    rows = result.withColumn("dataset_id", F.lit(dataset_id))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dataset_id").parquet(f"{base.rstrip('/')}/{kind}")


def read_result(spark: SparkSession, base: str, kind: str, dataset_id: str) -> DataFrame:
    """Stored results of one dataset; only its partition is read."""
    return spark.read.parquet(f"{base.rstrip('/')}/{kind}").where(F.col("dataset_id") == dataset_id)


def dataset_row(
    spark: SparkSession,
    dataset_id: str,
    filename: str,
    cleaned: TableTypes,
    report: CleanReport,
    raw_duplicates: int,
    domain: str,
    created_at,
    owner: str | None = None,
) -> DataFrame:
    """Summary of one dataset: shape of the cleaned table, faults of the raw one."""
    row = {
        "dataset_id": dataset_id,
        "owner": owner,
        "filename": filename,
        "row_count": cleaned.rows,
        "column_count": len(cleaned.columns),
        "numerical_columns": len(cleaned.numerical),
        "categorical_columns": len(cleaned.categorical),
        "date_columns": len(cleaned.dates),
        "missing_values": report.missing_values_before,
        "duplicate_rows": raw_duplicates,
        "dataset_domain": domain,
        "quality_score": report.scores()["quality_score"],
        "created_at": created_at,
    }
    return small_frame(spark, [row], DATASET_DDL)


def append_dataset(row: DataFrame, base: str) -> None:
    """Add datasets to the list; a repeated run replaces the row of its owner and dataset."""
    writer = row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("owner", "dataset_id").parquet(f"{base.rstrip('/')}/datasets")


def read_datasets(spark: SparkSession, base: str) -> DataFrame:
    """The list of datasets; ids and owners stay text, whatever they look like."""
    return spark.read.schema(DATASET_DDL).parquet(f"{base.rstrip('/')}/datasets")


def list_datasets(datasets: DataFrame, owner: str | None = None) -> DataFrame:
    """Newest datasets first, of one owner if given."""
    if owner is not None:
        datasets = datasets.where(F.col("owner") == owner)
    return datasets.orderBy(F.desc("created_at"), F.desc("dataset_id")).limit(LIST_LENGTH)


def _version_folders(base: str) -> tuple[str, str]:
    return f"{base.rstrip('/')}/dashboards", f"{base.rstrip('/')}/dashboard_commits"


def _version_log(spark: SparkSession, base: str) -> DataFrame:
    """One row per commit: its number, the folder that it wrote and the run that it belongs to."""
    return spark.read.schema(VERSION_LOG_DDL).json(_version_folders(base)[1])


def store_version(rows: DataFrame, base: str, run: str | None = None) -> bool:
    """Store the next version of the dashboards in ``rows`` (one row per ``dashboard_id``), with any number of writers.

    Rows go to a folder of their own, which counts only once its commit is published. Commits have consecutive numbers
    and a number can be claimed once; a writer that loses the race looks at the log again and tries the number after it.
    The version of a dashboard is its place among the commits that hold it, so a lost race rewrites no row. A ``run``
    that is named in the log already adds nothing, in which case the result is False.
    """
    spark, (data, log) = rows.sparkSession, _version_folders(base)
    if path_exists(spark, data) and not path_exists(spark, log):
        raise ValueError(f"{data} holds tables but no version log")
    make_folder(spark, log)
    write, written = f"w-{uuid.uuid4().hex}", False
    while True:
        known = _version_log(spark, base).agg(F.max("commit").alias("last"), F.bool_or(F.col("run") == F.lit(run)).alias("done")).first()
        if known["done"]:
            if written:
                drop_folder(spark, f"{data}/write={write}")
            return False
        if not written:
            rows.write.parquet(f"{data}/write={write}")
            written = True
        number = (known["last"] or 0) + 1
        if publish_once(spark, f"{log}/{number:020d}.json", json.dumps({"commit": number, "write": write, "run": run})):
            return True


def stored_versions(spark: SparkSession, base: str) -> DataFrame:
    """All committed rows with their ``commit``; folders without a commit (a lost writer's) are left out."""
    commits = _version_log(spark, base).select("write", "commit")
    return spark.read.parquet(_version_folders(base)[0]).join(commits, "write").drop("write")


def read_dashboard(spark: SparkSession, base: str, dashboard_id: str | None = None) -> DataFrame:
    """Latest version of one dashboard, or of all."""
    stored = stored_versions(spark, base)
    if dashboard_id is not None:
        stored = stored.where(F.col("dashboard_id") == dashboard_id)
    others = F.struct(*[c for c in stored.columns if c not in ("dashboard_id", "commit")])
    latest = stored.groupBy("dashboard_id").agg(F.max_by(others, "commit").alias("r"), F.count("*").alias("version"))
    return latest.select("dashboard_id", "r.*", "version")
