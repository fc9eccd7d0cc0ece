import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetlens.operators import anomaly, charts, filters, iforest, segment, series, slicer, stats
from sheetlens.sources.row_ids import with_row_id


def monthly(spark, sums):
    rows = [(dt.datetime(2024, m, 3), float(v)) for m, v in sums]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    return series.monthly_sums(df, F.col("t"), ["v"])


def test_correlation_with_gaps_and_constants(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 4.1, 5.0, 1.0), (3.0, None, 5.0, 2.0), (4.0, 8.3, 5.0, 0.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in stats.correlations(df, ["a", "b", "c", "d"]).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.1, 8.3])[0, 1])
    assert got[("a", "d")] == pytest.approx(np.corrcoef([2, 3, 4], [1, 2, 0.5])[0, 1])
    assert got[("a", "c")] == 0 and got[("c", "c")] == 0 and got[("a", "a")] == 1


def test_correlation_over_many_columns(spark, monkeypatch):
    monkeypatch.setattr(stats, "PAIRS_PER_JOB", 4)
    df = spark.range(30).select(*[F.sin(F.col("id") * (k + 1)).alias(f"m{k}") for k in range(6)])
    data = np.array([[np.sin(i * (k + 1)) for k in range(6)] for i in range(30)])
    rows = stats.correlations(df, df.columns).collect()
    assert len(rows) == 21
    for r in rows:
        assert r["r"] == pytest.approx(np.corrcoef(data.T)[r["order_a"], r["order_b"]])


def test_sales_correlation_is_found(spark, sales):
    pairs = stats.significant_pairs(stats.correlations(sales, ["Advertising Spend", "Sales"])).collect()
    assert pairs[0]["direction"] == "positive" and pairs[0]["strength"] == "strong"


def test_what_if_edges(spark):
    few = spark.createDataFrame([(1.0, 2.0)] * 4, "x double, y double")
    assert stats.what_if(few, "x", "y", 10).first()["success"] is False
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "x double, y double")
    assert stats.what_if(flat, "x", "y", 10).first()["success"] is False
    missing = stats.what_if(flat, "x", "z", 10).first()
    assert missing["success"] is False and "not found" in missing["error"]
    line = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "x double, y double")
    row = stats.what_if(line, "x", "y", 10).first()
    assert row["estimated_change"] == pytest.approx(9.0) and row["confidence_score"] == 95


def test_trend_and_growth(spark):
    m = monthly(spark, [(1, 100), (2, 110), (3, 0), (4, 130), (5, 150), (6, 160)])
    t = series.trends(m).first()
    assert (t["direction"], t["periods_analyzed"], t["total_pct_change"]) == ("increasing", 5, 60.0)
    assert (t["peak_period"], t["trough_period"]) == ("2024-06", "2024-01")
    assert series.growth(m).first()["growth_pct"] == 60.0


def test_trend_needs_rows_and_months(spark):
    assert series.trends(monthly(spark, [(1, 5), (2, 6), (3, 7), (4, 8)])).isEmpty()
    assert series.trends(monthly(spark, [(1, 5)] * 3 + [(2, 6)] * 3)).isEmpty()


def test_period_changes_fill_gaps(spark):
    m = monthly(spark, [(1, 100), (2, 150), (4, 120)])
    got = [(r["value"], r["pct_change"]) for r in series.period_changes(m).orderBy("month").collect()]
    assert got == [(100.0, None), (150.0, 50.0), (0.0, -100.0), (120.0, None)]
    assert series.period_anomalies(m).isEmpty()  # fewer than ten values
    worst = series.period_anomalies(monthly(spark, [(1, 100), (2, 150), (4, 120)] + [(4, 0)] * 8)).first()
    assert (worst["period"], worst["pct_change"], worst["direction"]) == ("March 2024", -100.0, "decrease")


def test_line_units(spark):
    def unit(days):
        df = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0), (dt.datetime(2020, 1, 1) + dt.timedelta(days=days), 2.0)], "t timestamp_ntz, v double")
        return [r["date"] for r in charts.line(df, F.col("t"), ["v"]).orderBy("period").collect()]

    assert unit(3) == ["Jan 01", "Jan 02", "Jan 03", "Jan 04"]
    assert unit(70)[:2] == ["2020-01", "2020-02"]
    assert unit(800) == ["2020", "2021", "2022"]


def test_histograms(spark):
    flat = spark.createDataFrame([(7.0,)] * 6, "v double")
    assert sum(r["count"] for r in charts.histogram(flat, "v").collect()) == 6
    assert [r["count"] for r in slicer.histogram(flat, "v").orderBy("bin").collect()] == [6, 0, 0, 0]
    df = spark.createDataFrame([(float(i),) for i in range(26)], "v double")
    rows = charts.histogram(df, "v").orderBy("bin").collect()
    assert [r["count"] for r in rows] == [6, 5, 5, 5, 5]
    assert rows[0]["bucket"] == "-0.0–5.0"
    assert charts.histogram(df.limit(0), "v").count() == 0


def test_groups_with_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 9.0)], "k string, v double")
    assert {r["label"]: r["value"] for r in charts.bar(df, "k", "v").collect()} == {"a": 3.0, "b": 0.0}
    assert {r["label"]: r["value"] for r in charts.bar(df, "k", "v", "mean").collect()} == {"a": 1.5}
    assert {r["label"]: r["value"] for r in slicer.bar(df, "k", "v").collect()} == {"a": 3.0, "b": 0.0, "Unknown": 9.0}
    assert charts.pie(df.where("k = 'a'"), "k", "v").isEmpty()


def test_box_needs_five_values(spark):
    df = spark.createDataFrame([(1.0,)] * 4, "v double")
    assert charts.box(df, "v").isEmpty()


def test_scatter_is_repeatable_and_bounded(spark):
    df = with_row_id(spark.range(5000).select(F.col("id").alias("_row_id"), F.col("id").cast("double").alias("x"), F.rand(1).alias("y")))
    a = {tuple(r) for r in charts.scatter(df, "x", "y").collect()}
    b = {tuple(r) for r in charts.scatter(df.repartition(13), "x", "y").collect()}
    assert a == b and len(a) == 75
    assert charts.scatter(df.limit(7), "x", "y").count() == 0


def test_anomaly_records_and_row_index(spark):
    rows = [(i, 10.0 + i % 5) for i in range(60)] + [(100 + i, 500.0 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "_row_id long, cost double")
    bounds = anomaly.outlier_bounds(df, ["cost"])
    assert anomaly.univariate_outliers(df, bounds).first()["iqr_outliers"] == 5
    records = anomaly.with_row_index(anomaly.merge_records(None, anomaly.iqr_records(df, bounds)), df).orderBy("record").collect()
    assert [(r["row_id"], r["row_index"], r["column"]) for r in records] == [(100, 61, "cost"), (101, 62, "cost"), (102, 63, "cost")]
    assert anomaly.outlier_bounds(df.limit(9), ["cost"]) == []


def test_forest_flags_injected_outliers(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 3))
    points[[7, 123, 400]] = [[9, -9, 9], [-10, 10, 8], [12, 11, -9]]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "_row_id long, a double, b double, c double")
    scored = iforest.isolation_forest(df, ["a", "b", "c"])
    flagged = {r["_row_id"] for r in scored.where("is_outlier").collect()}
    assert {7, 123, 400} <= flagged and len(flagged) == 30
    again = iforest.isolation_forest(df.repartition(3), ["a", "b", "c"])
    assert flagged == {r["_row_id"] for r in again.where("is_outlier").collect()}
    assert iforest.isolation_forest(df.limit(9), ["a", "b", "c"]) is None


def test_forest_sampling_of_a_large_table(spark):
    rows = spark.range(120_000).select(F.col("id").alias("_row_id"), F.rand(2).alias("v"))
    per_tree = [r["count"] for r in iforest.tree_samples(rows, 120_000).groupBy("tree").count().collect()]
    assert len(per_tree) == iforest.TREES and max(per_tree) == iforest.SUBSAMPLE and min(per_tree) > 220


def test_forest_paths_against_brute_force():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(64, 2))
    feature, threshold, path = (np.array(x) for x in iforest.grow(points, 6, 2))
    got = iforest.path_lengths(points, feature, threshold, path)
    for p, length in zip(points, got):
        at = 0
        for _ in range(6):
            at = 2 * at + 1 + int(p[feature[at]] > threshold[at])
        assert path[at] == length
    assert iforest.mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_forest_leaves_without_walking():
    random = np.random.default_rng(4)
    sample = [np.column_stack([random.normal(size=256), random.integers(0, 5, 256), random.lognormal(size=256)]) for _ in range(40)]
    sample[1] = np.ones((256, 3))
    trees = [tuple(np.array(x) for x in iforest.grow(points, 8, t)) for t, points in enumerate(sample)]
    # values on thresholds, beyond all of them and infinite ones
    on = [threshold[np.isfinite(threshold)][:20] for _, threshold, _ in trees]
    points = np.concatenate([*sample, *[np.column_stack([o, o, o]) for o in on], [[np.inf, -np.inf, 9e9], [-9e9, np.inf, -np.inf]]])
    got = iforest.Forest(trees, 3)(points)
    assert got.tolist() == sum(iforest.path_lengths(points, *t) for t in trees).tolist()
    assert max(len(iforest.splits_and_leaves(threshold, path)[1]) for _, threshold, path in trees) > iforest.LEAVES


def test_hashes_as_digits():
    values = [0, 1, 0x0A0B0C0D, 0x9FFFFFF1, 2**32 - 1]
    column = pa.array([f"{v:08x}" for v in values])
    assert segment._numbers(column).tolist() == values
    assert segment._numbers(column.slice(1, 3)).tolist() == values[1:4]
    assert segment._numbers(pa.array(values)).tolist() == values


def test_segments(spark):
    rows = [(float(i % 3) * 100 + i * 0.01, float(i % 3) * 50 - i * 0.01) for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b double")
    profile, score, reason = segment.segments(df, ["a", "b"])
    rows = profile.collect()
    assert reason is None and score > 0.9
    assert sum(r["size"] for r in rows) == 90 and len(rows) == 3
    assert {r["name"] for r in rows} == {segment.HIGH, segment.MIDDLE, segment.BASE}
    assert segment.segments(df, ["a"])[2] == segment.TOO_FEW_COLUMNS
    assert segment.segments(df.limit(14), ["a", "b"])[2] == segment.TOO_FEW_ROWS
    assert [segment.candidate_ks(n) for n in (20, 45, 60)] == [[2], [2, 3], [2, 3, 4]]


def test_segments_by_hand(spark):
    """The numpy form of ten starts a k over the same starting centres gives the same clusters and silhouette."""
    points = np.random.default_rng(5).normal(size=(240, 3)) * [1, 30, 0.2] + np.arange(240)[:, None] % 4 * [3, -60, 1]
    df = spark.createDataFrame([(*map(float, p),) for p in points], "a double, b double, c double").coalesce(1)
    profile, score, _ = segment.segments(df, ["a", "b", "c"])
    x = (points - points.mean(axis=0)) / points.std(axis=0)
    scale = segment.Scale(points.mean(axis=0), points.std(axis=0))
    ids = with_row_id(df).select("_row_id", *[F.conv(F.substring(F.md5(F.concat(F.lit("42:row:"), F.col("_row_id").cast("string")).cast("binary")), at, 8), 16, 10).cast("bigint").alias(f"h{at}") for at in (1, 9)], "a", "b", "c")
    starts = segment.starting_centres(ids, scale, 4)
    best = None
    for k in (2, 3, 4):
        tried = []
        for s in range(segment.STARTS):
            centres = starts[s, :k]
            for _ in range(segment.STEPS):
                label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
                moved = np.array([x[label == j].mean(axis=0) for j in range(k)])
                shift, centres = ((moved - centres) ** 2).sum(), moved
                if shift <= segment.TOLERANCE:
                    break
            d = ((x[:, None] - centres) ** 2).sum(axis=2)
            tried.append((d.min(axis=1).sum(), s, d.argmin(axis=1)))
        label = min(tried, key=lambda t: t[:2])[2]
        apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        values = []
        for i in range(len(x)):
            mean = [apart[i, label == j].sum() / ((label == j).sum() - (j == label[i])) for j in range(k)]
            own, other = mean[label[i]], min(m for j, m in enumerate(mean) if j != label[i])
            values.append((other - own) / max(own, other))
        if best is None or np.mean(values) > best[0]:
            best = (np.mean(values), label)
    assert score == pytest.approx(best[0], abs=1e-9)
    rows = {r["cluster"]: r for r in profile.collect()}
    assert {c: r["size"] for c, r in rows.items()} == {c: int((best[1] == c).sum()) for c in set(best[1].tolist())}
    for c, r in rows.items():
        assert [r["mean_a"], r["mean_b"], r["mean_c"]] == pytest.approx(points[best[1] == c].mean(axis=0), abs=0.006)


def test_segment_blocks():
    """Leaves that go to a centre at once and rows compared one by one give every row its nearest centre; picks are the shortest waits."""
    random = np.random.default_rng(3)
    raw = np.concatenate([random.normal(size=(4500, 3)) * [1, 40, 0.1], np.repeat([[9.0, 0.0, 0.5]], 700, axis=0)])
    keys = np.column_stack([random.permutation(len(raw)), *random.integers(0, 2**32, (2, len(raw)))])
    scale = segment.Scale(raw.mean(axis=0), raw.std(axis=0))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in [*keys[i : i + 999].T, *raw[i : i + 999].T]], list("abcdef")) for i in range(0, len(raw), 999)]
    blocks = list(segment._blocks(scale)(batches))
    found = [np.concatenate(part) for part in zip(*segment._unpacked(3)(blocks))]
    order = found[0][:, 0].argsort()
    assert (found[0][order] == keys[keys[:, 0].argsort()]).all() and (found[1][order] == raw[keys[:, 0].argsort()]).all()
    x, far = scale(raw), 3.0 * np.eye(3)
    models = {k: np.concatenate([far[:1], random.normal(size=(k - 1, 3))]) for k in (2, 3, 4)} | {7: np.repeat(far[:1], 2, axis=0)}
    out = [batch.to_pandas() for batch in segment._assigned(scale, models, whole=True)(iter(blocks))]
    assert len(out) == 1
    for m, centres in models.items():
        d = ((x[:, None] - centres) ** 2).sum(axis=2)
        label = d.argmin(axis=1)
        for c in range(len(centres)):
            part = out[0][(out[0].m == m) & (out[0].c == c)].sort_values("i")
            assert (part.n == (label == c).sum()).all()
            assert part.x.to_numpy() == pytest.approx(x[label == c].sum(axis=0), abs=1e-8)
            assert part.xx.to_numpy() == pytest.approx((x[label == c] ** 2).sum(axis=0), abs=1e-8)
            assert part.near.to_numpy() == pytest.approx(d[label == c, c].sum(), abs=1e-8)
    # most leaves of the largest block need no look at their rows
    middle, reach = np.frombuffer(blocks[0].column("leaves")[0].as_buffer()).reshape(4, -1, 3)[:2]
    assert next(segment.Sides(models)(middle, reach)).any(axis=0).mean() > 0.5
    chosen = random.normal(size=(segment.STARTS, 2, 3))
    picks = [batch.to_pandas() for batch in segment._picks(scale, chosen, 2, segment._unpacked(3))(iter(blocks))][0].set_index("start")
    for s in range(segment.STARTS):
        a, b, c, d = segment._mixer(s, 2)
        high, low = (a * keys[:, 1] + b) % segment.PRIME, (c * keys[:, 2] + d) % segment.PRIME
        wait = -np.log(1.0 - (high + (low + 1) / (segment.PRIME + 1.0)) / segment.PRIME) / ((x[:, None] - chosen[s]) ** 2).sum(axis=2).min(axis=1)
        assert picks.row[s] == keys[wait.argmin(), 0] and picks.wait[s] == pytest.approx(wait.min())


def test_segments_of_odd_tables(spark):
    schema = "a double, b double, _h1 string"
    rows = [(1.0, 2.0, "x")] * 10 + [(3.0, 2.0, "y")] * 10 + [(None, 1.0, "z"), (float("nan"), 1.0, None)]
    profile, score, _ = segment.segments(spark.createDataFrame(rows, schema), ["a", "b"])
    found = sorted((r["size"], r["mean_a"], r["mean_b"]) for r in profile.collect())
    assert found == [(10, 1.0, 2.0), (10, 3.0, 2.0)] and score == 1.0
    assert segment.segments(spark.createDataFrame([(1.0, 2.0, "x")] * 20, schema), ["a", "b"])[2] == segment.ALL_ALIKE
    endless = [(float(i), float("inf") if i == 3 else 1.0, "x") for i in range(20)]
    assert segment.segments(spark.createDataFrame(endless, schema), ["a", "b"])[2] == segment.INFINITE
    assert segment.segments(spark.createDataFrame([], schema), ["a", "b"])[2] == segment.TOO_FEW_ROWS


def test_filters(spark):
    rows = [(1, 5.0, "A", True), (2, 6.5, "b ", False), (3, None, None, True)]
    df = spark.createDataFrame(rows, "k int, v double, s string, f boolean")

    def keys(out):
        return sorted(r["k"] for r in out.collect())

    assert keys(filters.apply_filters(df, {"v": 5.0})) == [1]
    assert keys(filters.apply_filters(df, {"v": 5})) == []  # "5" is not the text of 5.0
    assert keys(filters.apply_filters(df, {"k": "2", "f": False})) == [2]
    assert keys(filters.apply_filters(df, {"v": {"min": 5.5}})) == [2]
    assert keys(filters.apply_filters(df, {"s": None, "k": "all"})) == [1, 2, 3]
    assert keys(filters.apply_slicers(df, {"s": "B"})) == [2]
    assert keys(filters.apply_slicers(df, {"v": [0, 6]})) == [1]
    assert keys(filters.search_rows(df, "TRUE")) == [1, 3]
    assert keys(filters.search_rows(df, ".")) == [1, 2]
    assert filters.display(df).where("k = '3'").first()["s"] == ""


def test_pages(spark):
    df = spark.range(95).select(F.col("id").alias("_row_id"), (F.col("id") * 2).alias("v")).repartition(6)
    for page, size in ((1, 10), (4, 30), (5, 30)):
        want = [str(2 * i) for i in range(95)][(page - 1) * size : page * size]
        for dense in (False, True):
            assert sorted(r["v"] for r in filters.page_rows(df, page, size, dense_ids=dense).collect()) == sorted(want)
    gaps = df.where("v % 3 = 0")
    assert [r["v"] for r in filters.page_rows(gaps, 2, 5).orderBy("_row_id").collect()] == ["30", "36", "42", "48", "54"]


def test_pages_by_position(spark):
    ids = [i * 700 + i % 3 for i in range(3000)] + [(5 << 40) + i for i in range(2000)]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "_row_id bigint, v string").repartition(5)
    want = [str(i) for i in ids]
    index = filters.page_index(df)
    assert index.agg(F.sum("n")).first()[0] == 5000
    for page, size in ((1, 10), (60, 50), (61, 50), (3, 1999), (101, 50)):
        got = [r["v"] for r in filters.page_at(df, index, page, size).orderBy("_row_id").collect()]
        assert got == want[(page - 1) * size : page * size]
    assert [r["v"] for r in filters.page_at(df, index, None, 30).orderBy("_row_id").collect()] == want[4980:]
    hits = [v for v in want if "77" in v]
    found = filters.page_at(df, filters.page_index(df, "77"), 2, 20, "77")
    assert [r["v"] for r in found.orderBy("_row_id").collect()] == hits[20:40]
    assert "TakeOrdered" not in found._jdf.queryExecution().executedPlan().toString()
    empty = df.where("v = 'none'")
    assert filters.page_at(empty, filters.page_index(empty)).count() == 0


def test_correlations_of_many_columns_with_gaps(spark):
    rng = np.random.default_rng(3)
    width, rows = 40, 300
    values = rng.normal(size=(rows, width)) + rng.normal(size=(rows, 1)) + 1e6
    values[rng.random((rows, width)) < 0.3] = np.nan
    values[:, 5] = np.where(np.arange(rows) % 2, 0.1 + np.arange(rows), np.where(np.arange(rows) % 4, 0.1, np.nan))
    values[:, 6] = np.where(np.arange(rows) % 4 == 2, np.arange(rows), np.nan)  # column 5 is constant where this one is there
    values[:, 7] = np.where(np.arange(rows) % 4 == 0, np.arange(rows), np.nan)  # column 5 is missing where this one is there
    values[:, 8], values[:, 9] = 3.0, np.arange(rows)
    names = [f"c{i}" for i in range(width)]
    frame = pa.table({n: pa.array(values[:, i], from_pandas=True) for i, n in enumerate(names)})
    df = spark.createDataFrame(frame).repartition(4)
    got = stats.correlations(df, names).toPandas()
    assert len(got) == width * (width + 1) // 2
    for row in got.itertuples():
        x, y = values[:, row.order_a], values[:, row.order_b]
        both = ~np.isnan(x) & ~np.isnan(y)
        x, y = x[both], y[both]
        flat = len(x) == 0 or x.min() == x.max() or y.min() == y.max()
        assert row.r == (0.0 if flat else pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-7))


def test_correlations_without_gaps_or_rows(spark):
    values = np.random.default_rng(4).normal(size=(500, 3)).cumsum(1)
    df = spark.createDataFrame(pa.table({n: values[:, i] for i, n in enumerate("abc")}))
    got = {(r["col_a"], r["col_b"]): r["r"] for r in stats.correlations(df, ["a", "b", "c"]).collect()}
    want = np.corrcoef(values.T)
    assert got["a", "c"] == pytest.approx(want[0, 2]) and got["b", "c"] == pytest.approx(want[1, 2]) and got["a", "a"] == 1.0
    none = {(r["col_a"], r["col_b"]): r["r"] for r in stats.correlations(df.where("a > 1e9"), ["a", "b"]).collect()}
    assert none == {("a", "a"): 0.0, ("a", "b"): 0.0, ("b", "b"): 0.0}
    assert stats.correlations(df, []).count() == 0


def test_time_filters(spark):
    rows = [(1, dt.datetime(2024, 5, 1, 0, 0)), (2, dt.datetime(2024, 5, 1, 23, 59, 59)), (3, dt.datetime(2024, 5, 2)), (4, None)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz")

    def keys(out):
        return sorted(r["k"] for r in out.collect())

    assert keys(filters.apply_filters(df, {"t": "2024-05-01"})) == [1, 2]
    assert keys(filters.apply_filters(df, {"t": ["2024-05-02", "not a time"]})) == [3]
    assert keys(filters.apply_filters(df, {"t": "soon"})) == []
    assert keys(filters.apply_slicers(df, {"t": ["2024-05-01", "2024-05-01"]})) == [1, 2]


def test_filter_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out = filters.apply_filters(df, {"o_orderstatus": "F", "o_totalprice": {"min": 10}}).select("o_orderkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F), GreaterThanOrEqual(" in plan
    assert "o_orderpriority" not in plan
