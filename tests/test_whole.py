import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import ask, clean, insight, kpi, profile, recommend
from sheetlens.plans import analysis
from sheetlens.session import new_path
from sheetlens.sources import csv, samples, tables


@pytest.fixture(scope="module")
def analysed(spark):
    df = samples.sample_table(spark, "sales").cache()
    return df, analysis.analyse(df)


def test_dashboard_of_sample(spark, analysed):
    df, a = analysed
    sections = {r["section"]: r["content"] for r in analysis.dashboard(df, "d1", 97.5, a).collect()}
    assert sections["title"] == '"Sales Analytics Dashboard"'
    parsed = {k: json.loads(v) for k, v in sections.items()}
    kinds = [c["type"] for c in parsed["charts"]]
    assert len(kinds) <= 8 and len(set(kinds)) == len(kinds) and kinds[0] == "line"
    assert len(parsed["kpis"]) == 4
    assert len(parsed["summary"][0]["key_takeaways"]) == 5
    assert parsed["insights"][0]["priority"] == "critical"
    assert sum(r["size"] for r in parsed["clusters"]) == 400


@pytest.mark.parametrize("kind,domain", [("marketing", "Marketing Performance"), ("healthcare", "Healthcare & Clinical Analytics")])
def test_other_samples(spark, kind, domain):
    df = samples.sample_table(spark, kind, 60).cache()
    a = analysis.analyse(df, forest=False)
    rows = {r["section"]: r["content"] for r in analysis.dashboard(df, kind, a=a).collect()}
    assert domain in rows["title"]


def test_injected_cost_is_reported(spark):
    rows = [(f"D{i:03d}", ["Alpha", "Beta", "Gamma"][i % 3], 100.0 + i % 17, 40.0 + (i * 7) % 23, f"2024-0{i % 6 + 1}-11") for i in range(100)]
    rows[42] = (*rows[42][:3], rows[42][3] * 8, rows[42][4])
    df = spark.createDataFrame(rows, "delivery_id string, carrier string, distance double, shipping_cost double, dispatch_date string").coalesce(1)
    a = analysis.analyse(df)
    hits = a.records.where("column = 'shipping_cost'").collect()
    assert 43 in {r["row_index"] for r in hits}


def test_table_without_dates_or_numbers(spark):
    words = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "k string, s string")
    a = analysis.analyse(words)
    assert a.trends is None and a.records is None
    sections = {r["section"] for r in analysis.dashboard(words, "w", a=a).collect()}
    assert {"kpis", "summary", "filters"} <= sections and "insights" not in sections


def test_options_with_any_sign(spark):
    rows = [(v, float(i)) for i, v in enumerate(["a|b", "a", "b", "a|b", ' "q"', "", None, "a"])]
    df = spark.createDataFrame(rows, "label string, amount double")
    found = {r["column"]: r["options"] for r in kpi.filter_catalogue(df, profile.infer_types(df)).collect()}
    assert found["label"] == [' "q"', "a", "a|b", "b"]


def test_single_row(spark):
    one = spark.createDataFrame([(1.0, 2.0, "a", dt.datetime(2024, 1, 1))], "x double, y double, k string, t timestamp_ntz")
    assert analysis.dashboard(one, "one").count() > 5


def test_insight_rules(spark, analysed):
    _, a = analysed
    cards = insight.insight_cards(a.facts())
    top = insight.prioritise(cards).collect()
    order = {"critical": 0, "important": 1, "informational": 2}
    ranks = [order[r["priority"]] for r in top]
    assert ranks == sorted(ranks) and len(top) <= 10
    singles = [r["provenance"]["source_columns"][0] for r in top if len(r["provenance"]["source_columns"]) == 1]
    assert len(singles) == len(set(singles))
    assert insight.filter_insights(insight.prioritise(cards), "critical").where("priority <> 'critical'").isEmpty()


def test_answers(spark, analysed):
    df, a = analysed
    asked = [
        ("What is the average Sales?", "average", "en"),
        ("total sales please", "total", "en"),
        ("Spread of adve", "distribution", "en"),
        ("Which Region has the highest Sales?", "ranking", "en"),
        ("top Product by count", "frequency", "en"),
        ("are metrics linked?", "correlation", "en"),
        ("any outlier", "anomaly", "en"),
        ("growth", "trend", "en"),
        ("show data table", "open_explorer", "en"),
        ("why is this high", "context", "en"),
        ("Sales का औसत", "average", "hi"),
        ("Sales ची सरासरी", "average", "mr"),
        ("hello", "summary", "en"),
    ]
    q = spark.createDataFrame([(x,) for x, _, _ in asked], "question string")
    out = ask.answer_questions(q, analysis.answers(df, a, {"Region": "North"}), a.types)
    got = {r["question"]: r for r in out.collect()}
    for text, intent, language in asked:
        assert (got[text]["intent"], got[text]["language"]) == (intent, language)
        assert got[text]["answer"]
    north = df.where("Region = 'North'").agg(F.avg("Sales"), F.count("*")).first()
    assert f"{north[0]:,.2f}" in got["What is the average Sales?"]["answer"]
    assert f"({north[1]:,} records after active filters)" in got["hello"]["answer"]


def test_context_column_names_the_chart(spark, analysed):
    df, a = analysed
    q = spark.createDataFrame([("why is this high", "Advertising Spend by Region")], "question string, context string")
    row = ask.resolve_questions(q, a.types).first()
    # the first table column named in the context is a category here, so no metric is explained
    assert row["col_a"] is None or row["col_a"] in a.types.numerical


def test_recommendation_rules():
    types = profile.TableTypes(
        50,
        [
            profile.ColumnType("when", "datetime", "date", 50, 0, 50),
            profile.ColumnType("region", "categorical", "string", 50, 0, 4),
            profile.ColumnType("city", "categorical", "string", 50, 0, 20),
            profile.ColumnType("year", "numerical", "int", 50, 0, 3),
            profile.ColumnType("sales", "numerical", "double", 50, 0, 50),
        ],
    )
    specs = {s.kind: s for s in recommend.recommend(types, ("year", "sales", 0.5))}
    assert specs["bar"].x == "region" and specs["horizontal_bar"].y == ("city",)
    assert specs["horizontal_bar"].x == "sales"
    assert specs["pie"].x == "region" and "heatmap" not in specs and "scatter" in specs
    assert "scatter" not in {s.kind for s in recommend.recommend(types, ("year", "sales", 0.4))}


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def test_csv_rules(spark, tmp_path):
    text = '﻿id, name ,a,a,gone,flag,n\n1," x, ""q""",1.5,NA,,True,1\n2,N/A,2,7,,False,\n,,,,,,\n3,y,null,8,,True,3\n'
    df = csv.read_csv(spark, write(tmp_path, "t.csv", text.encode()))
    assert df.drop("_row_id").dtypes == [("id", "bigint"), ("name", "string"), ("a", "double"), ("a.1", "bigint"), ("flag", "boolean"), ("n", "bigint")]
    rows = [tuple(r)[:-1] for r in df.orderBy("_row_id").collect()]
    assert rows == [(1, ' x, "q"', 1.5, None, True, 1), (2, None, 2.0, 7, False, None), (3, "y", None, 8, True, 3)]


def test_csv_latin1(spark, tmp_path):
    df = csv.read_csv(spark, write(tmp_path, "l.csv", "stadt,n\nKöln,1\nBonn,2\n".encode("latin-1")))
    assert {r["stadt"] for r in df.collect()} == {"Köln", "Bonn"}


def test_csv_faults(spark, tmp_path):
    with pytest.raises(csv.IngestError):
        csv.read_csv(spark, write(tmp_path, "t.xlsx", b"x"))
    with pytest.raises(csv.IngestError):
        csv.read_csv(spark, write(tmp_path, "e.csv", b""))
    with pytest.raises(csv.IngestError):
        csv.read_csv(spark, write(tmp_path, "h.csv", b"a,b\n"))
    with pytest.raises(csv.IngestError):
        csv.read_csv(spark, write(tmp_path, "m.csv", b"a\n1\n2\n"), max_rows=1)


def test_parquet_row_ids_follow_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    df = csv.ingest(spark, path)
    got = [r["id"] for r in df.orderBy("_row_id").collect()]
    assert got == list(range(100)) and df.select("_row_id").distinct().count() == 100


def test_stores(spark, messy):
    base = new_path(spark, "store")
    cleaned, report = clean.clean(messy)
    types = profile.infer_types(cleaned)
    for k, owner in enumerate(("ana", "ben", "ana")):
        made = dt.datetime(2024, 1, 1 + k)
        tables.append_dataset(tables.dataset_row(spark, f"d{k}", "f.csv", types, report, 3, "general", made, owner), base)
    listed = tables.list_datasets(spark.read.parquet(f"{base}/datasets"), "ana").collect()
    assert [r["dataset_id"] for r in listed] == ["d2", "d0"] and listed[0]["row_count"] == 3
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "dashboard_id string, v int")
    tables.store_version(rows, base)
    tables.store_version(rows.where("dashboard_id = 'x'"), base)
    assert {r["dashboard_id"]: r["version"] for r in tables.read_dashboard(spark, base).collect()} == {"x": 2, "y": 1}
    assert tables.read_dashboard(spark, base, "x").count() == 1


def test_shared_folder_is_taken_from_the_session(spark, monkeypatch):
    class Named:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "/shared/here" if key == "spark.checkpoint.dir" else default

    assert new_path(Named, "x").startswith("/shared/here/")


def test_staged_table_keeps_rows_and_schema(spark, messy):
    from sheetlens.session import stage

    staged = stage(messy, "t")
    assert staged.schema == messy.schema and sorted(map(str, staged.collect())) == sorted(map(str, messy.collect()))
