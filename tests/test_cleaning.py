import random

from pyspark.sql import functions as F

from sheetlens.operators import clean
from sheetlens.plans.queries import cleaning


def values(df, c):
    return [r[0] for r in df.orderBy("_row_id").select(F.col(f"`{c}`")).collect()]


def test_messy_table_by_hand(spark, messy):
    out, report = clean.clean(messy)
    assert sorted((r["Category"], r["Value"]) for r in out.collect()) == [("A", 10.0), ("B", 30.0), ("B", 40.0)]
    assert (report.rows_after, report.duplicate_rows_removed) == (3, 4)
    assert report.scores() == {
        "completeness_score": 85.7,
        "duplicate_free_score": 42.9,
        "consistency_score": 100.0,
        "quality_score": 73.6,
    }
    assert report.missing_values_filled["Value"]["fill_value"] == 30.0
    assert report.missing_values_filled["Category"]["fill_value"] == "B"


def test_currency_and_percent(spark):
    rows = [("$1,200.50", "10%"), ("$980.00", "5%"), ("1500", "50"), ("€2,000", "15%")]
    out, report = clean.clean(spark.createDataFrame(rows, "Amount string, Discount string").coalesce(1))
    assert values(out, "Amount") == [1200.5, 980.0, 1500.0, 2000.0]
    # one percent sign scales the whole column
    assert values(out, "Discount") == [0.1, 0.05, 0.5, 0.15]
    assert report.scores()["consistency_score"] == 96.0


def test_hit_rate_below_limit_keeps_text(spark):
    df = spark.createDataFrame([("1",)] * 8 + [("none given",)] * 2, "v string")
    out, report = clean.clean(df)
    assert report.columns_format_fixed == {} and dict(out.dtypes)["v"] == "string"


def test_casing(spark):
    rows = [(x,) for x in ("male", "Male", "MALE ", " female", "Female", "female")]
    out, report = clean.clean(spark.createDataFrame(rows, "Gender string"))
    assert sorted(values(out, "Gender")) == ["Female", "Male"]
    assert report.duplicate_rows_removed == 4
    assert report.scores()["consistency_score"] == 98.5


def test_hyphens_blanks_and_codes(spark):
    rows = [(1, "well-known  brand"), (2, "\tother one\n"), (3, "third"), (4, "fourth"), (5, "fifth"), (6, "X-1")]
    out, _ = clean.clean(spark.createDataFrame(rows, "k int, label string").coalesce(1))
    assert values(out, "label") == ["Well-Known Brand", "Other One", "Third", "Fourth", "Fifth", "X-1"]


def test_ids_and_dates_are_left(spark):
    rows = [(float(i) if i else None, f"2024-01-{i + 1:02d}" if i != 3 else None) for i in range(10)]
    out, report = clean.clean(spark.createDataFrame(rows, "`Customer ID` double, `Signup Date` string"))
    assert report.missing_values_filled == {}
    assert report.missing_values_left == {"Customer ID": 1, "Signup Date": 1}
    assert report.missing_values_after == 2


def test_fractional_median_of_integers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "e")], "n long, k string")
    out, _ = clean.clean(df)
    assert sorted(values(out, "n")) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_clean_table_is_unchanged(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "k long, v double")
    out, report = clean.clean(df)
    assert out.count() == 20
    log = [r["detail"] for r in clean.cleaning_log(spark, report).collect()]
    assert log == ["✓ No cleaning was necessary -- dataset passed all hygiene checks."]


def test_boolean_and_missing_modes(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, None), (4, False)], "k long, ok boolean")
    out, report = clean.clean(df)
    assert report.missing_values_filled["ok"]["fill_value"] == "True"
    assert out.where("k = 3").first()["ok"] is True


def test_no_copies_left_when_one_row_fills_a_third(spark):
    rows = [("hot", 1.0)] * 500 + [(f"k{i}", float(i)) for i in range(1000)]
    out, report = clean.clean(spark.createDataFrame(rows, "k string, v double").repartition(7))
    assert report.duplicate_rows_removed == 499
    assert out.drop("_row_id").distinct().count() == out.count() == 1001


def test_report_row(spark, messy):
    row = clean.report_frame(spark, clean.clean(messy)[1]).first()
    assert row["missing_values_filled"]["Category"]["count"] == 1
    assert row["quality_score"] == 73.6


def test_rows_that_filling_makes_equal(spark):
    rng = random.Random(5)
    rows = sorted({(rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice([0.0, 2.5, None]), rng.choice("ab")) for _ in range(200)}, key=str)
    rows = [(i * 3, *r, {"k": i % 2}) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "_row_id bigint, s string, n int, v double, w string, m map<string,int>").repartition(4)
    filled = {"s": {"value": "x"}, "n": {"value": 1.5}, "v": {"value": 2.5}}
    got, dropped = clean.impute_and_drop(df, filled)
    seen = {}
    for at, s, n, v, w, m in rows:
        seen.setdefault((s or "x", 1.5 if n is None else float(n), 2.5 if v is None else v, w, m["k"]), at)
    found = {(r["s"], r["n"], r["v"], r["w"], r["m"]["k"]): r["_row_id"] for r in got.collect()}
    assert found == seen and dropped == len(rows) - len(seen) > 0
    again, none = clean.impute_and_drop(df.where("w = 'a' AND n = 1"), {"n": {"value": 1.0}})
    assert none == 0 and again.count() == len([r for r in rows if r[4] == "a" and r[2] == 1])


def test_fills_read_written_rows(spark, tmp_path, monkeypatch):
    """The distinct rows are made once, not again for every scan that classes and fill values take."""
    rows = [(i, 1, float(50 if i < 3 else i % 40), 100.0 + i, i % 4 / 100, i % 3 / 100, "AR"[i % 5 > 2]) for i in range(60)]
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    plans, real = [], clean.fill_values
    monkeypatch.setattr(clean, "fill_values", lambda df, types: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, types))[1])
    (row,) = cleaning.clean_impute_mode(spark, str(tmp_path)).collect()
    flags = [r[6] for r in rows if r[5] > 0]
    assert (row["column"], row["count"], row["fill_value"]) == ("flag", len(rows) - len(flags), max("AR", key=flags.count))
    assert "Aggregate" not in plans[0] and "Exchange" not in plans[0]
