"""Files that come and go: row order, CSV round trips, stored versions."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import charts, filters
from sheetlens.session import drop_staged, new_path, path_exists, run_together, small_frame, stage
from sheetlens.sources import csv, tables
from sheetlens.sources.row_ids import read_parquet


def test_row_order_is_file_order_whatever_the_split_order(spark, tmp_path):
    # larger files are read first, so split order differs from file order
    for name, ids in (("a", range(0, 10)), ("b", range(10, 5000)), ("c", range(5000, 5003))):
        spark.createDataFrame([(i, "x" * 50) for i in ids], "id bigint, pad string").coalesce(1).write.parquet(str(tmp_path / name))
        part = next(f for f in os.listdir(tmp_path / name) if f.endswith(".parquet"))
        os.makedirs(tmp_path / "all", exist_ok=True)
        os.rename(tmp_path / name / part, tmp_path / "all" / f"{name}.parquet")
    rows = read_parquet(spark, str(tmp_path / "all"))
    assert [r["id"] for r in rows.orderBy("_row_id").collect()] == list(range(5003))


def test_csv_parts_keep_their_order(spark, tmp_path):
    for name, ids in (("p0", range(3)), ("p1", range(3, 400)), ("p2", range(400, 402))):
        (tmp_path / "t.csv").mkdir(exist_ok=True)
        (tmp_path / "t.csv" / f"{name}.csv").write_text("id,v\n" + "".join(f'{i},"a\n{i}"\n' for i in ids))
    rows = csv.read_csv(spark, str(tmp_path / "t.csv")).orderBy("_row_id").collect()
    assert [(r["id"], r["v"]) for r in rows] == [(i, f"a\n{i}") for i in range(402)]


def test_csv_round_trip_keeps_values(spark):
    values = [(10**18 + i, f"{10**25 + i}", f"  padded {i} ", 'say "x",\nthen y') for i in range(10)]
    df = spark.createDataFrame(values, "n bigint, wide string, s string, t string").withColumn("at", F.expr("timestamp_ntz'2024-01-05 10:00:00' + make_interval(0,0,0,0,0,0,n % 7)"))
    df = df.withColumn("day", F.lit("2024-02-03").cast("timestamp_ntz"))
    back = csv.read_csv(spark, tables.export_csv(df, new_path(spark, "export"), "x.csv"))
    assert dict(back.dtypes)["n"] == "bigint" and dict(back.dtypes)["wide"] == "decimal(38,0)"
    got = {r["n"]: r for r in back.collect()}
    for n, wide, s, t in values:
        assert (got[n]["wide"], got[n]["s"], got[n]["t"], got[n]["day"]) == (Decimal(wide), s, t, "2024-02-03")
        assert got[n]["at"] == f"2024-01-05 10:00:0{n % 7}"


def test_versions_do_not_restart_on_a_broken_store(spark):
    base = new_path(spark, "store")
    rows = spark.createDataFrame([("d", "x")], "dashboard_id string, body string")
    tables.store_version(rows, base)
    tables.store_version(rows, base)
    assert tables.read_dashboard(spark, base, "d").first()["version"] == 2
    broken = new_path(spark, "store")
    rows.write.parquet(f"{broken}/dashboards")
    with pytest.raises(Exception, match="version"):
        tables.store_version(rows, broken)


def test_writers_at_once_get_versions_of_their_own(spark):
    base = new_path(spark, "store")
    frames = [spark.createDataFrame([("d", f"body {i}"), (f"own {i}", "x")], "dashboard_id string, body string") for i in range(5)]
    made = run_together({str(i): (lambda i=i: tables.store_version(frames[i], base)) for i in range(5)})
    assert all(made.values())
    stored = tables.stored_versions(spark, base)
    assert sorted(r["commit"] for r in stored.where("dashboard_id = 'd'").collect()) == [1, 2, 3, 4, 5]
    versions = {r["dashboard_id"]: r["version"] for r in tables.read_dashboard(spark, base).collect()}
    assert versions == {"d": 5} | {f"own {i}": 1 for i in range(5)}
    last = stored.where("dashboard_id = 'd' AND commit = 5").first()["body"]
    assert tables.read_dashboard(spark, base, "d").first()["body"] == last


def test_a_repeated_or_lost_run_adds_no_version(spark):
    base = new_path(spark, "store")
    rows = spark.createDataFrame([("d", "x")], "dashboard_id string, body string")
    at_once = run_together({str(i): (lambda: tables.store_version(rows, base, run="monday")) for i in range(3)})
    assert sorted(at_once.values()) == [False, False, True]
    assert not tables.store_version(rows, base, run="monday")
    # a writer that was lost before its commit
    rows.write.parquet(f"{base}/dashboards/write=w-lost")
    assert tables.read_dashboard(spark, base, "d").first()["version"] == 1
    assert tables.store_version(rows, base, run="tuesday")
    assert tables.read_dashboard(spark, base, "d").first()["version"] == 2


def test_a_repeated_dataset_row_replaces_its_own(spark):
    base = new_path(spark, "datasets")
    for rows in (3, 4, 4):
        row = {"dataset_id": "007", "owner": None if rows == 3 else "ana", "row_count": rows}
        tables.append_dataset(small_frame(spark, [row], tables.DATASET_DDL), base)
    got = tables.read_datasets(spark, base).select("dataset_id", "owner", "row_count").orderBy("row_count").collect()
    assert got == [("007", None, 3), ("007", "ana", 4)]


def test_a_repeated_store_replaces_its_own_results(spark):
    base = new_path(spark, "results")
    for dataset in ("a", "b", "a"):
        tables.append_result(spark.range(3).withColumn("v", F.lit(1)), base, "bars", dataset)
    assert spark.read.parquet(f"{base}/bars").groupBy("dataset_id").count().orderBy("dataset_id").collect() == [("a", 3), ("b", 3)]


def test_staged_tables_are_removed(spark):
    df = stage(spark.range(5).toDF("id"), "gone")
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    assert path_exists(spark, folder)
    drop_staged(df)
    assert not path_exists(spark, folder)


def test_slicer_with_an_open_start(spark):
    df = spark.createDataFrame([("2024-01-03",), ("2024-01-07",)], "d string")
    assert [r["d"] for r in filters.apply_slicers(df, {"d": [None, "2024-01-05"]}).collect()] == ["2024-01-03"]
    numbers = spark.createDataFrame([(-3.0,), (2.0,)], "v double")
    assert [r["v"] for r in filters.apply_slicers(numbers, {"v": ["-5", "-1"]}).collect()] == [-3.0]


def test_bucket_labels_never_collide():
    for low, width in ((1000.0, 0.0004), (0.0, 1e-7), (5.0, 0.02), (1e6, 10.0), (99.9, 0.05), (-1.0, 0.25)):
        labels = charts.bucket_labels([low + width * i for i in range(11)])
        assert len(set(labels)) == 10
    assert charts.bucket_labels([0.0, 50.0, 100.0, 1234.6]) == ["0.0–50.0", "50–100", "100–1,234"]


def test_questions_about_a_category_without_values_fall_through(spark):
    from sheetlens.operators import ask, profile

    types = profile.infer_types(spark.createDataFrame([(f"c{i % 3}", float(i)) for i in range(60)], "cat string, v double"))
    active = spark.createDataFrame([(None, 1.0), (None, 2.0)], "cat string, v double")
    asked = ask.question_frame(spark, ["which cat has the highest v?", "count by cat", "what is the average v?"])
    rows = ask.answer_questions(asked, ask.possible_answers(active, types), types).collect()
    assert all(r["answer"] is not None for r in rows)
