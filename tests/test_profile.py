import datetime as dt
import random

from pyspark.sql import functions as F

from sheetlens.functions import names
from sheetlens.functions.counts import distinct_counts, modes
from sheetlens.functions.quantiles import exact_quantiles, exact_ranks
from sheetlens.functions.values import half_up
from sheetlens.operators import domain, profile
from sheetlens.sources.row_ids import with_positions


def classes(df, **kw):
    return {c.name: c.sem_type for c in profile.infer_types(df, **kw).columns}


def test_sales_classes(spark, sales):
    assert classes(sales) == {
        "Order Date": "datetime",
        "Region": "categorical",
        "Product": "categorical",
        "Advertising Spend": "numerical",
        "Sales": "numerical",
    }
    best = domain.classify_domain(domain.domain_scores(sales)).first()
    assert best["domain"] == "sales"


def test_class_rules(spark):
    rows = [(i, f"row-{i}", 7, i % 2 == 0, "x" * 40 + str(i), f"0{i % 9 + 1}/02/2024", None) for i in range(100)]
    df = spark.createDataFrame(
        rows, "`Student ID` long, `uuid` string, constant int, flag boolean, story string, day string, empty string"
    )
    for unique in ("all", "labels", "needed"):
        assert classes(df, unique=unique) == {
            "Student ID": "id",
            "uuid": "id",
            "constant": "categorical",
            "flag": "boolean",
            "story": "text",
            "day": "datetime",
            "empty": "categorical",
        }


def test_types_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert classes(empty) == {"a": "categorical", "b": "categorical"}
    nested = spark.createDataFrame([([1.0, 2.0], {"k": 1}), ([1.0, 2.0], {"k": 1})], "v array<double>, m map<string,int>")
    assert profile.duplicate_rows(nested).first()[0] == 1
    assert set(classes(nested)) == {"v", "m"}
    dotted = spark.createDataFrame([(1.5, "x"), (2.5, "y")], "`a.b` double, `c d` string")
    assert classes(dotted) == {"a.b": "numerical", "c d": "categorical"}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "v double")
    c = profile.infer_types(df, "all").columns[0]
    assert (c.present, c.missing, c.unique, c.missing_pct(4)) == (2, 2, 2, 50.0)


def test_date_rate_threshold(spark):
    def share(good):
        rows = [("2024-01-05",)] * good + [("later",)] * (10 - good)
        return classes(spark.createDataFrame(rows, "d string"))["d"]

    assert share(8) == "datetime"
    assert share(7) == "categorical"


def test_datetime_granularity(spark):
    def step(days):
        rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=days * i),) for i in range(12)]
        df = spark.createDataFrame(rows, "t timestamp_ntz")
        return profile.datetime_stats(df, profile.infer_types(df)).first()["granularity"]

    assert [step(d) for d in (1, 7, 30, 365)] == ["Daily", "Weekly", "Monthly", "Yearly"]


def test_profile_job_count_does_not_follow_columns(spark):
    """The same number of jobs is submitted for 4 and for 24 numeric columns."""
    tracker = spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        jobs = []
        for width in (4, 24):
            df = spark.range(50).select(*[(F.col("id") * (k + 1)).cast("double").alias(f"m{k}") for k in range(width)])
            spark.sparkContext.setJobGroup(f"w{width}", "profile")
            profile.numeric_stats(df, df.columns)
            profile.infer_types(df)
            jobs.append(len(tracker.getJobIdsForGroup(f"w{width}")))
        assert jobs[0] == jobs[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_quantiles_agree_with_builtin_on_skewed_values(spark):
    random.seed(3)
    values = [5.0] * 700 + [random.gauss(0, 1) * 10 ** random.randint(-3, 9) for _ in range(1300)] + [1e300, -1e300]
    df = spark.createDataFrame([(v, v if v > 0 else None) for v in values], "a double, b double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    want = {c: list(df.agg(F.percentile(c, F.array(*[F.lit(p) for p in probs]))).first()[0]) for c in ("a", "b")}
    assert exact_quantiles(df, ["a", "b"], probs) == want
    assert exact_quantiles(df, ["a", "b"], probs, direct=10, pick=10) == want
    ordered = sorted(values)
    assert exact_ranks(df, "a", len(values), [0, 17, 1000, 2001], pick=5) == [ordered[i] for i in (0, 17, 1000, 2001)]


def test_quantiles_beside_infinite_values(spark):
    values = [float("inf"), float("-inf")] + [float(i) for i in range(99)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    assert exact_quantiles(df, ["a"], [0.25, 0.5, 0.75], direct=5, pick=5) == {"a": [24.0, 49.0, 74.0]}


def test_quantiles_of_missing_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}


def test_counts_and_modes(spark):
    df = spark.createDataFrame([("b", 1, None), ("a", 1, None), ("b", 2, None), ("a", None, None)], "x string, y int, z string")
    assert distinct_counts(df, ["x", "y", "z"]) == {"x": 2, "y": 2, "z": 0}
    assert modes(df, ["x", "y", "z"]) == {"x": "a", "y": 1, "z": None}


def test_names():
    assert names.is_id_name("Customer ID") and not names.is_id_name("Sales")
    assert not names.is_measure_name("Hospital Stay Days")
    assert names.is_slicer_name("Hospital Stay Days") and not names.is_slicer_name("zip")


def test_half_up():
    assert half_up(2.675, 2) == 2.68
    assert half_up(None, 2) is None


def test_positions_are_dense(spark):
    ids = [3, 9, 2**18 + 1, 2**18 + 7, 2**33 + 5, 2**40]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "_row_id long")
    got = {r["_row_id"]: r["row_index"] for r in with_positions(df).collect()}
    assert got == {i: k + 1 for k, i in enumerate(ids)}


def test_domain_words_in_values(spark):
    rng = random.Random(8)
    words = sorted({w for _, _, keywords in domain.DOMAINS for w in keywords})
    values = [rng.choice(["", "x", "Le\nad", "qq"]) + rng.choice(words).upper() + rng.choice(["ing", "\n", " no"]) for _ in range(40)]
    rows = [(values[i % 40], None if i % 3 else "sto", "ck") for i in range(300)]  # no word across two columns or rows
    df = spark.createDataFrame(rows, "a string, b string, c string").repartition(3)
    want = sorted(w for w in words if any(w in v.lower() for row in rows for v in row if v))
    assert domain._held_words(df).first()["held"] == want
    assert domain._held_words(df.where("a = 'none'")).first()["held"] == []
    assert domain._held_words(df.select(F.length("a").alias("n"))).first()["held"] == []
