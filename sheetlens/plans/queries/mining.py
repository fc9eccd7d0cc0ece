"""Queries over outliers, monthly changes, trends, the forest and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlens.operators import anomaly, filters, iforest, segment, series
from sheetlens.plans.queries.registry import (
    CHANGES_SQL,
    PERIODS_SQL,
    SALES_LINES_SQL,
    TRENDS_SQL,
    VALUE_COLUMNS,
    bounds_sql,
    months_sql,
    outliers_sql,
    query,
    sales_lines,
    table,
    union,
)

ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_MONTHS = months_sql("orders", "o_orderdate", ORDER_NUMBERS)
LINE_MONTHS = months_sql("sales_lines", "l_shipdate", VALUE_COLUMNS)


@query(f"""
WITH {SALES_LINES_SQL}, {bounds_sql('sales_lines', VALUE_COLUMNS)}, {outliers_sql('sales_lines', VALUE_COLUMNS)}
SELECT * FROM outliers
""")
def univariate_outliers_lineitem(spark, sf_dir):
    df = sales_lines(spark, sf_dir)
    return anomaly.univariate_outliers(df, anomaly.outlier_bounds(df, VALUE_COLUMNS))


@query(f"""
WITH {bounds_sql('events', ['value'])}, {outliers_sql('events', ['value'])}
SELECT "column", zscore_outliers FROM outliers
""")
def zscore_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return anomaly.univariate_outliers(df, anomaly.outlier_bounds(df, ["value"])).select("column", "zscore_outliers")


@query(f"""
WITH {bounds_sql('events', ['value'])}, {outliers_sql('events', ['value'])}
SELECT "column", iqr_outliers FROM outliers
""")
def iqr_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return anomaly.univariate_outliers(df, anomaly.outlier_bounds(df, ["value"])).select("column", "iqr_outliers")


def records_sql(source: str, columns: list[str]) -> str:
    """CTE ``records``: the first three IQR outliers per column, over CTE ``bounds``."""
    parts = [
        f"""SELECT * FROM (SELECT b.col_order, 'anomaly_{c}_' || row_id AS id, row_id, '{c}' AS "column", t.{c} AS raw, b.*
            EXCLUDE (col_order), row_number() OVER (ORDER BY row_id) AS k
            FROM {source} t, bounds b WHERE b.col = '{c}' AND (t.{c} < b.lower_fence OR t.{c} > b.upper_fence)) WHERE k <= 3"""
        for c in columns
    ]
    return f"""
first_records AS ({union(parts)}),
scored_records AS (SELECT *, CAST(least(98, 80 + floor(abs(raw - mean) / std * 5)) AS INTEGER) AS anomaly_score FROM first_records),
records AS (
  SELECT id, row_id, "column", round(raw, 2) AS value,
         format('{{:.1f}} – {{:.1f}}', lower_fence, upper_fence) AS expected_range, 'IQR & Z-Score' AS method, anomaly_score,
         'Value ' || format('{{:,.2f}}', raw) || ' is substantially outside the normal expected range ('
           || format('{{:.1f}}', lower_fence) || ' to ' || format('{{:.1f}}', upper_fence) || ').' AS explanation,
         CASE WHEN anomaly_score >= 90 THEN 'High' ELSE 'Medium' END AS severity,
         CAST(row_number() OVER (ORDER BY col_order, row_id) AS INTEGER) AS record, row_id + 1 AS row_index
  FROM scored_records ORDER BY col_order, row_id LIMIT 25)
"""


def _records(df, columns):
    found = anomaly.merge_records(None, anomaly.iqr_records(df, anomaly.outlier_bounds(df, columns)))
    return anomaly.with_row_index(found, df)


@query(f"WITH {SALES_LINES_SQL}, {bounds_sql('sales_lines', VALUE_COLUMNS)}, {records_sql('sales_lines', VALUE_COLUMNS)} SELECT * FROM records")
def anomaly_records_iqr(spark, sf_dir):
    return _records(sales_lines(spark, sf_dir), VALUE_COLUMNS)


EVENT_ROWS_SQL = "event_rows AS (SELECT *, row_number() OVER () - 1 AS row_id FROM events)"


@query(f"""
WITH {EVENT_ROWS_SQL}, {bounds_sql('event_rows', ['value'])}, {records_sql('event_rows', ['value'])}
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(value AS VARCHAR) AS value, e.row_id, m."column" AS anomaly_column,
       m.method AS anomaly_method, m.anomaly_score
FROM (SELECT event_id, value, row_id FROM event_rows ORDER BY row_id LIMIT 100) e
LEFT JOIN (SELECT row_id, "column", method, anomaly_score FROM records) m ON m.row_id = e.row_id
""")
def anomaly_overlay(spark, sf_dir):
    df = table(spark, sf_dir, "events", ids=True).select("event_id", "value", "_row_id")
    page = filters.page_rows(df, 1, 100)
    return filters.anomaly_overlay(page, _records(df, ["value"])).withColumnRenamed("_row_id", "row_id")


@query(f"WITH {ORDER_MONTHS}, {CHANGES_SQL} SELECT col_order, col, month, n_rows AS rows, months, round(v, 2) AS value, round(pct_change, 4) AS pct_change FROM changes")
def period_changes_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    changes = series.period_changes(series.monthly_sums(df, F.col("o_orderdate"), ORDER_NUMBERS))
    return changes.withColumn("pct_change", F.round("pct_change", 4))


@query(f"WITH {ORDER_MONTHS}, {CHANGES_SQL}, {PERIODS_SQL} SELECT * FROM periods")
def period_anomaly_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return series.period_anomalies(series.monthly_sums(df, F.col("o_orderdate"), ORDER_NUMBERS))


@query(f"WITH {ORDER_MONTHS}, {TRENDS_SQL} SELECT * FROM trends")
def trend_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return series.trends(series.monthly_sums(df, F.col("o_orderdate"), ORDER_NUMBERS))


@query(f"WITH {SALES_LINES_SQL}, {LINE_MONTHS}, {TRENDS_SQL} SELECT * FROM trends")
def trend_lineitem(spark, sf_dir):
    df = sales_lines(spark, sf_dir)
    return series.trends(series.monthly_sums(df, F.col("l_shipdate"), VALUE_COLUMNS))


CUSTOMER_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]


def forest_sql(source: str, columns: list[str]) -> str:
    """CTEs up to ``forest_scores`` (row_id, values, sum of path lengths): sampling, ten levels of splits, scoring.

    ``source`` has row_id and the columns. Nodes are numbered as in a complete binary tree.
    """
    seed, trees, want, drawn, word = iforest.SEED, iforest.TREES, iforest.SUBSAMPLE, iforest.DRAWN, iforest.WORD
    depth = f"(SELECT CAST(greatest(1, ceil(log2(least({want}, n)))) AS BIGINT) FROM forest_sizes)"
    number = "CAST('0x' || substr({0}, {1}, 8) AS BIGINT)".format
    mean = "CASE WHEN {0} <= 1 THEN 0.0 WHEN {0} = 2 THEN 1.0 ELSE 2.0 * (ln({0} - 1) + 0.5772156649015329) - 2.0 * ({0} - 1) / {0} END".format
    spread = [f"CASE WHEN max({c}) > min({c}) THEN {i} END" for i, c in enumerate(columns)]
    low, high = (", ".join(f"{f}({c})" for c in columns) for f in ("min", "max"))
    node = "md5('{0}:split:' || tree || ':' || node)".format(seed)
    levels = []
    for level in range(8):
        chosen = f"usable[1 + {number(node, 1)} % greatest(1, len(usable))]"
        levels.append(f"""
splits{level} AS MATERIALIZED (
  SELECT tree, node, n, len(usable) = 0 OR n <= 1 OR {level} >= {depth} AS is_leaf, {chosen} AS f,
         lows[1 + {chosen}] + (highs[1 + {chosen}] - lows[1 + {chosen}]) * ({number(node, 9)} / {float(word)}) AS t
  FROM (SELECT tree, node, count(*) AS n, list_filter([{", ".join(spread)}], lambda x: x IS NOT NULL) AS usable, [{low}] AS lows, [{high}] AS highs
        FROM level{level} GROUP BY tree, node)
), level{level + 1} AS MATERIALIZED (
  SELECT s.tree, 2 * s.node + CASE WHEN [{", ".join(columns)}][1 + s.f] > s.t THEN 2 ELSE 1 END AS node, r.row_id, {", ".join("r." + c for c in columns)}
  FROM level{level} r JOIN splits{level} s ON s.tree = r.tree AND s.node = r.node WHERE NOT s.is_leaf
)""")
    walks = []
    for level in range(8):
        walks.append(f"""
walk{level + 1} AS MATERIALIZED (
  SELECT w.tree, CAST(2 * w.node + CASE WHEN [{", ".join("p." + c for c in columns)}][1 + s.f] > s.t THEN 2 ELSE 1 END AS SMALLINT) AS node, w.row_id
  FROM walk{level} w JOIN splits{level} s ON s.tree = w.tree AND s.node = w.node JOIN forest_points p ON p.row_id = w.row_id WHERE NOT s.is_leaf
)""")
    ends = [f"SELECT w.row_id, {level} AS level, s.n FROM walk{level} w JOIN splits{level} s ON s.tree = w.tree AND s.node = w.node WHERE s.is_leaf" for level in range(8)]
    ends.append("SELECT w.row_id, 8 AS level, s.n FROM walk8 w JOIN (SELECT tree, node, count(*) AS n FROM level8 GROUP BY tree, node) s ON s.tree = w.tree AND s.node = w.node")
    values = ", ".join(columns)
    return f"""
forest_points AS MATERIALIZED (SELECT row_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)} FROM ({source}) WHERE {" AND ".join(c + " IS NOT NULL" for c in columns)}),
forest_sizes AS MATERIALIZED (SELECT count(*) AS n, least({word}, {trees * drawn * word} // count(*)) AS any_tree FROM forest_points),
forest_limits AS MATERIALIZED (SELECT n, any_tree, CASE WHEN any_tree = {word} THEN least({word}, {drawn * word} // n) ELSE {word // trees} END AS one_tree FROM forest_sizes),
forest_hashed AS (
  SELECT p.*, t.tree, md5('{seed}:tree:' || p.row_id || ':' || t.tree // 4) AS h, one_tree
  FROM forest_points p, forest_limits, (SELECT unnest(range(0, {trees})) AS tree) t WHERE {number(f"md5('{seed}:any:' || p.row_id)", 1)} < any_tree
), forest_drawn AS (SELECT *, CAST('0x' || substr(h, CAST(1 + 8 * (tree % 4) AS INTEGER), 8) AS BIGINT) AS u FROM forest_hashed),
forest_picked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY u, row_id) AS place FROM forest_drawn WHERE u < one_tree),
level0 AS MATERIALIZED (SELECT tree, 0 AS node, row_id, {values} FROM forest_picked WHERE place <= {want}),{",".join(levels)},
walk0 AS (SELECT CAST(t.tree AS SMALLINT) AS tree, CAST(0 AS SMALLINT) AS node, p.row_id FROM forest_points p, (SELECT DISTINCT tree FROM level0) t),{",".join(walks)},
forest_paths AS MATERIALIZED (
  SELECT row_id, CAST(sum(CAST(level AS BIGINT) * {iforest.PATH_UNITS} + CAST(round(({mean("n")}) * {iforest.PATH_UNITS}) AS BIGINT)) AS BIGINT) AS total FROM ({" UNION ALL ".join(ends)}) GROUP BY row_id
), forest_scores AS (
  SELECT p.*, total, power(2.0, -(total / ({trees} * ({mean(f"least({want}, n)")}) * {float(iforest.PATH_UNITS)}))) AS score FROM forest_points p JOIN forest_paths USING (row_id), forest_sizes
), forest_flags AS MATERIALIZED (
  SELECT * FROM forest_scores WHERE total < (SELECT total FROM forest_scores ORDER BY total DESC LIMIT 1 OFFSET (SELECT CAST(floor({1 - iforest.CONTAMINATION} * (n - 1)) AS BIGINT) FROM forest_sizes))
)"""


def top_column_sql(columns: list[str]) -> str:
    best = f"list_position([{', '.join(columns)}], greatest({', '.join(columns)}))"
    return f"[{', '.join(repr(c) for c in columns)}][{best}] AS top_column, greatest({', '.join(columns)}) AS top_value"


@query(f"""
WITH {forest_sql("SELECT c_custkey AS row_id, * FROM customer", CUSTOMER_NUMBERS)}
SELECT row_id, round(score, 6) AS score, {top_column_sql(CUSTOMER_NUMBERS)} FROM forest_flags
""")
def iforest_flags(spark, sf_dir):
    scored = iforest.isolation_forest(table(spark, sf_dir, "customer", ids=True), CUSTOMER_NUMBERS)
    return scored.where("is_outlier").select(F.col("_row_id").alias("row_id"), F.round("score", 6).alias("score"), "top_column", "top_value")


@query(f"""
WITH {forest_sql("SELECT c_custkey AS row_id, * FROM customer", CUSTOMER_NUMBERS)},
shown AS (SELECT row_id, {top_column_sql(CUSTOMER_NUMBERS)} FROM forest_flags ORDER BY row_id LIMIT {anomaly.FOREST_RECORDS})
SELECT 'anomaly_' || row_id AS id, row_id, top_column AS "column", top_value AS value, 'Isolation Forest' AS method, CAST({anomaly.FOREST_SCORE} AS INTEGER) AS anomaly_score, 'High' AS severity,
       'Multivariate outlier flagged across numerical attributes (' || top_column || ' = ' || regexp_replace(format('{{:,.2f}}', top_value), '0$', '') || ').' AS explanation,
       CAST(row_number() OVER (ORDER BY row_id) AS INTEGER) AS record, row_id + 1 AS row_index
FROM shown
""")
def anomaly_records_forest(spark, sf_dir):
    """Records of the first rows that the forest flags."""
    df = table(spark, sf_dir, "customer", ids=True)
    flagged = iforest.isolation_forest(df, CUSTOMER_NUMBERS).where("is_outlier").orderBy("_row_id").limit(anomaly.FOREST_RECORDS)
    records = anomaly.merge_records(anomaly.flagged_records(flagged), anomaly.iqr_records(df, []))
    return anomaly.with_row_index(records, df).drop("expected_range")


@query(f"""
WITH {forest_sql("SELECT event_id AS row_id, * FROM events", ["user_id", "value"])},
{bounds_sql('events', ['user_id', 'value'])}, {EVENT_ROWS_SQL}, {records_sql('event_rows', ['user_id', 'value'])}
SELECT count(DISTINCT row_id) AS total_anomalies
FROM (SELECT row_id FROM forest_flags UNION ALL SELECT row_id FROM records WHERE record <= {anomaly.ALL_RECORDS} - least({anomaly.FOREST_RECORDS}, (SELECT count(*) FROM forest_flags)))
""")
def total_anomalies(spark, sf_dir):
    df = table(spark, sf_dir, "events", ids=True).select("event_id", "user_id", "value", "_row_id")
    scored = iforest.isolation_forest(df, ["user_id", "value"])
    flagged = scored.where("is_outlier")
    records = anomaly.merge_records(
        anomaly.flagged_records(flagged.orderBy("_row_id").limit(anomaly.FOREST_RECORDS)),
        anomaly.iqr_records(df, anomaly.outlier_bounds(df, ["user_id", "value"])),
    )
    return anomaly.total_anomalies(flagged, records)


def kmeans_sql(source: str, columns: list[str]) -> str:
    """CTEs up to ``segments`` (cluster, name, size, share, means) and ``segment_head`` (n_clusters, silhouette_score).

    ``source`` has row_id and the columns. Every start and k is a row of centres; one recursion moves them all.
    """
    p, most, prime = range(len(columns)), range(4), segment.PRIME
    number = "CAST('0x' || substr({0}, {1}, 8) AS BIGINT)".format
    x = [f"x{i}" for i in p]
    # c<j>_<i>: column i of centre j; the centres a model does not have are null, and so are its distances to them
    centre = [[f"c{j}_{i}" for i in p] for j in most]
    flat = ", ".join(c for cs in centre for c in cs)
    near = [" + ".join(f"(p.{x[i]} - m.{centre[j][i]}) ** 2" for i in p) for j in most]
    label = "CASE least(d0, d1, d2, d3) WHEN d0 THEN 0 WHEN d1 THEN 1 WHEN d2 THEN 2 ELSE 3 END"
    distances = ", ".join(f"{near[j]} AS d{j}" for j in most)
    seeds = []
    for j in most:
        h = f"md5('{segment.SEED}:seed:' || m.start || ':{j}')"
        mixed = [f"((1 + {number(h, 1 + 16 * i)} % {prime - 1}) * p.h{i} + {number(h, 9 + 16 * i)} % {prime}) % {prime}" for i in range(2)]
        wait = f"-ln(1.0 - ({mixed[0]} + ({mixed[1]} + 1) / {prime + 1.0}) / {float(prime)})"
        so_far = ", ".join(c for cs in centre[:j] for c in cs)
        rate = f"least({', '.join(f'({near[g]})' for g in range(j))})" if j else "1.0"
        before = f"km_seed{j - 1}" if j else f"(SELECT unnest(range(0, {segment.STARTS})) AS start)"
        seeds.append(f"""
km_seed{j} AS MATERIALIZED (
  SELECT start, {so_far + ", " if j else ""}{", ".join(f"best.{x[i]} AS {centre[j][i]}" for i in p)}
  FROM (SELECT m.start, {"".join(f"any_value(m.{c}) AS {c}, " for cs in centre[:j] for c in cs)}
               arg_min({{{", ".join(f"'{v}': p.{v}" for v in x)}}}, ({wait} / ({rate}), p.row_id)) FILTER ({rate} > 0) AS best
        FROM km_points p, {before} m GROUP BY m.start))""")
    first = ", ".join(f"CASE WHEN k > {j} THEN {c} END" for j in most for c in centre[j])
    moved = ", ".join(f"coalesce(avg({x[i]}) FILTER (label = {j}), any_value({c})) AS {c}" for j in most for i, c in enumerate(centre[j]))
    shift = " + ".join(f"coalesce((n.{c} - o.{c}) ** 2, 0)" for cs in centre for c in cs)
    of = "m.k, m.start, " + ", ".join(f"m.{c}" for cs in centre for c in cs)
    assigned = f"SELECT *, {label} AS label FROM (SELECT {of}, p.*, {distances} FROM km_points p, {{0}} m)".format
    spread = " + ".join(f"var_pop({v}) * count(*)" for v in x)
    gap = " + ".join(f"(p.{v} - t.m_{v}) ** 2" for v in x)
    live = " + ".join(f"CAST(max({c}) > min({c}) AS INTEGER)" for c in columns)
    return f"""
km_rows AS MATERIALIZED (SELECT row_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)} FROM ({source}) WHERE {" AND ".join(c + " IS NOT NULL" for c in columns)}),
km_scale AS MATERIALIZED (
  SELECT count(*) AS n, {segment.TOLERANCE} * ({live}) / {len(columns)}.0 AS tolerance,
         {", ".join(f"avg({c}) AS mean{i}, CASE WHEN max({c}) > min({c}) THEN stddev_pop({c}) ELSE 1.0 END AS std{i}" for i, c in enumerate(columns))} FROM km_rows),
km_points AS MATERIALIZED (
  SELECT row_id, {", ".join(f"{c} AS raw{i}, ({c} - mean{i}) / std{i} AS {x[i]}" for i, c in enumerate(columns))},
         {", ".join(number(f"md5('{segment.SEED}:row:' || row_id)", 1 + 8 * i) + f" AS h{i}" for i in range(2))} FROM km_rows, km_scale),{",".join(seeds)},
km_lloyd AS MATERIALIZED (
  WITH RECURSIVE steps AS (
    SELECT k, start, 0 AS step, false AS done, {first.replace("END", "END AS {}").format(*[c for cs in centre for c in cs])}
    FROM km_seed3, (SELECT unnest(range(2, greatest(3, least(5, n // 10)))) AS k FROM km_scale)
    UNION ALL
    SELECT o.k, o.start, o.step + 1, {shift} <= (SELECT tolerance FROM km_scale), {", ".join(f"n.{c}" for cs in centre for c in cs)}
    FROM (SELECT * FROM steps WHERE NOT done AND step < {segment.STEPS}) o
    JOIN (SELECT k, start, {moved} FROM ({assigned("(SELECT * FROM steps WHERE NOT done)")}) GROUP BY k, start) n ON n.k = o.k AND n.start = o.start
  ) SELECT k, start, {flat} FROM steps WHERE done OR step = {segment.STEPS}),
km_best AS MATERIALIZED (
  SELECT m.* FROM km_lloyd m JOIN (
    SELECT k, min(start) AS start FROM (
      SELECT k, start, inertia, min(inertia) OVER (PARTITION BY k) AS least FROM (SELECT k, start, sum(least(d0, d1, d2, d3)) AS inertia FROM ({assigned("km_lloyd")}) GROUP BY k, start)
    ) WHERE inertia <= {segment.ALIKE} * least GROUP BY k
  ) b ON b.k = m.k AND b.start = m.start),
km_labels AS MATERIALIZED (SELECT k, label, row_id, {", ".join(f"raw{i}" for i in p)}, {", ".join(x)} FROM ({assigned("km_best")})),
km_clusters AS MATERIALIZED (
  SELECT k, label, count(*) AS n, {spread} AS within, {", ".join(f"avg({v}) AS m_{v}" for v in x)}, {", ".join(f"avg(raw{i}) AS mean{i}" for i in p)} FROM km_labels GROUP BY k, label),
km_values AS (
  SELECT k, row_id, own, other, alone FROM (
    SELECT p.k, p.row_id, max(CASE WHEN t.label = p.label THEN (t.n * ({gap}) + t.within) / greatest(t.n - 1, 1) END) AS own,
           min(CASE WHEN t.label <> p.label THEN {gap} + t.within / t.n END) AS other, bool_or(t.label = p.label AND t.n = 1) AS alone
    FROM km_labels p JOIN km_clusters t ON t.k = p.k GROUP BY p.k, p.row_id)),
km_scores AS (SELECT k, avg(CASE WHEN alone OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END) AS score FROM km_values GROUP BY k),
km_winner AS MATERIALIZED (SELECT k, score FROM km_scores ORDER BY score DESC, k LIMIT 1),
segment_head AS MATERIALIZED (SELECT count(*) AS n_clusters, round(any_value(score), 3) AS silhouette_score FROM km_clusters JOIN km_winner USING (k)),
segments AS (
  SELECT CAST(label AS INTEGER) AS cluster,
         CASE WHEN place = 1 THEN '{segment.HIGH}' WHEN place = k THEN '{segment.BASE}' WHEN place = 2 THEN '{segment.MIDDLE}' ELSE 'Segment ' || (label + 1) END AS name,
         n AS size, round(100.0 * n / rows, 1) AS pct_of_data, {", ".join(f"round(mean{i}, 2) AS mean_{c}" for i, c in enumerate(columns))}
  FROM (SELECT *, row_number() OVER (ORDER BY {" + ".join(f"mean{i}" for i in p)} DESC, label) AS place, sum(n) OVER () AS rows FROM km_clusters JOIN km_winner USING (k)))"""


@query(f"""
WITH {kmeans_sql("SELECT c_custkey AS row_id, * FROM customer", CUSTOMER_NUMBERS)}
SELECT s.*, silhouette_score FROM segments s, segment_head
""")
def kmeans_profile(spark, sf_dir):
    profile, score, _ = segment.segments(table(spark, sf_dir, "customer", ids=True), CUSTOMER_NUMBERS)
    return profile.withColumn("silhouette_score", F.round(F.lit(score), 3))
