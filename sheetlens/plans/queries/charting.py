"""Queries over chart series, their recomputation on sliced rows, and headline numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlens.operators import charts, filters, kpi, profile, recommend, slicer, stats
from sheetlens.operators.series import growth, monthly_sums
from sheetlens.plans.queries.registry import (
    SALES_LINES_SQL,
    SIGNIFICANT_SQL,
    VALUE_COLUMNS,
    months_sql,
    pairs_sql,
    query,
    sales_lines,
    table,
)


def _bar_sql(source: str, label: str, value: str, k: int, width: int) -> str:
    return (
        f"SELECT substr(label, 1, {width}) AS label, round(v, 2) AS value FROM (SELECT {label} AS label, {value} AS v "
        f"FROM {source} WHERE {label} IS NOT NULL GROUP BY 1 ORDER BY v DESC, label LIMIT {k})"
    )


@query(_bar_sql("lineitem", "l_returnflag", "sum(l_extendedprice)", 8, 18))
def bar_sum_returnflag(spark, sf_dir):
    return charts.bar(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@query(_bar_sql("customer", "c_mktsegment", "avg(c_acctbal)", 8, 18))
def bar_mean_segment(spark, sf_dir):
    return charts.bar(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "mean")


@query(_bar_sql("part", "p_brand", "sum(p_retailprice)", 8, 20))
def hbar_rank_brand(spark, sf_dir):
    return charts.ranking(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query("""
SELECT substr(label, 1, 15) AS label, round(v, 2) AS value, round(100 * v / sum(v) OVER (), 2) AS share_pct
FROM (SELECT o_orderpriority AS label, sum(o_totalprice) AS v FROM orders GROUP BY 1 ORDER BY v DESC, label LIMIT 6)
""")
def pie_share_priority(spark, sf_dir):
    return charts.pie(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


def _histogram_sql(source: str, c: str) -> str:
    edges = "CASE WHEN b >= bins THEN hi ELSE lo + b * ((hi - lo) / bins) END"
    at = " + ".join(f"(CASE WHEN {i} < bins AND v > lo + {i} * ((hi - lo) / bins) THEN 1 ELSE 0 END)" for i in range(1, 10))
    shown_left, shown_right = "round(left_edge, 3)", "round(right_edge, 3)"
    return f"""
WITH vals AS (SELECT CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL),
head AS (SELECT min(v) AS lo, max(v) AS hi, least(10, greatest(5, CAST(floor(sqrt(count(*))) AS INTEGER))) AS bins FROM vals),
grid AS (SELECT CAST(b AS INTEGER) AS bin, lo, hi, {edges} AS left0, {edges.replace('b >= bins', 'b + 1 >= bins').replace('b * (', '(b + 1) * (')} AS right_edge
         FROM head, generate_series(0, 9) g(b) WHERE b < bins),
shown AS (SELECT bin, CASE WHEN bin = 0 THEN left0 - 0.001 * (hi - lo) ELSE left0 END AS left_edge, right_edge FROM grid),
counts AS (SELECT {at} AS bin, count(*) AS n FROM vals, head GROUP BY 1)
SELECT s.bin, left_edge, right_edge, coalesce(n, 0) AS count,
       CASE WHEN {shown_right} >= 100
            THEN format('{{:,}}–{{:,}}', CAST(trunc({shown_left}) AS BIGINT), CAST(trunc({shown_right}) AS BIGINT))
            ELSE format('{{:.1f}}–{{:.1f}}', {shown_left}, {shown_right}) END AS bucket
FROM shown s LEFT JOIN counts c ON c.bin = s.bin
"""


@query(_histogram_sql("lineitem", "l_extendedprice"))
def histogram_extendedprice(spark, sf_dir):
    return charts.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(_histogram_sql("events", "value"))
def histogram_event_value(spark, sf_dir):
    return charts.histogram(table(spark, sf_dir, "events"), "value")


def _box_sql(source: str, c: str) -> str:
    return f"""
WITH q AS (SELECT min({c}) AS lo, max({c}) AS hi, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {source}),
f AS (SELECT *, greatest(lo, q1 - 1.5 * (q3 - q1)) AS lower_fence, least(hi, q3 + 1.5 * (q3 - q1)) AS upper_fence FROM q)
SELECT '{c}' AS metric, round(lo, 2) AS min, round(q1, 2) AS q1, round(q2, 2) AS median, round(q3, 2) AS q3, round(hi, 2) AS max,
       round(avg({c}), 2) AS mean, count(*) FILTER (WHERE {c} < lower_fence OR {c} > upper_fence) AS outlier_count, count({c}) AS total_records
FROM {source}, f GROUP BY lo, hi, q1, q2, q3
"""


@query(_box_sql("orders", "o_totalprice"))
def box_totalprice(spark, sf_dir):
    return charts.box(table(spark, sf_dir, "orders"), "o_totalprice")


@query(_box_sql("events", "value"))
def box_event_value(spark, sf_dir):
    return charts.box(table(spark, sf_dir, "events"), "value")


def _line_sql(source: str, ts: str, unit: str, label: str, measures: list[str]) -> str:
    sums = ", ".join(f"sum({m}) AS {m}" for m in measures)
    shown = ", ".join(f"round(coalesce({m}, 0), 2) AS {m}" for m in measures)
    return f"""
WITH s AS (SELECT CAST(date_trunc('{unit}', {ts}) AS DATE) AS period, {sums} FROM {source} GROUP BY 1),
calendar AS (SELECT CAST(unnest(generate_series(CAST(min(period) AS TIMESTAMP), CAST(max(period) AS TIMESTAMP), INTERVAL 1 {unit})) AS DATE) AS period FROM s)
SELECT strftime(period, '{label}') AS date, period, {shown} FROM calendar LEFT JOIN s USING (period)
"""


@query(_line_sql("orders", "o_orderdate", "year", "%Y", ["o_totalprice"]))
def line_series_orders(spark, sf_dir):
    return charts.line(table(spark, sf_dir, "orders"), F.col("o_orderdate"), ["o_totalprice"])


@query(_line_sql("events", "ts", "day", "%b %d", ["value"]))
def line_series_events(spark, sf_dir):
    return charts.line(table(spark, sf_dir, "events"), F.col("ts"), ["value"])


# ---- correlation and what-if ------------------------------------------------------

LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""
WITH {pairs_sql('lineitem', LINEITEM_NUMBERS)}
SELECT a AS col_a, b AS col_b, round(r, 3) AS r FROM pairs UNION ALL SELECT b, a, round(r, 3) FROM pairs WHERE oa < ob
""")
def corr_matrix_lineitem(spark, sf_dir):
    return stats.correlation_matrix(stats.correlations(table(spark, sf_dir, "lineitem"), LINEITEM_NUMBERS))


@query(f"""
WITH {SALES_LINES_SQL}, {pairs_sql('sales_lines', VALUE_COLUMNS)}, {SIGNIFICANT_SQL}
SELECT column_a, column_b, correlation, strength, direction,
       column_a || ' and ' || column_b || ' show a ' || strength || ' ' || direction || ' correlation (r = ' || format('{{:.2f}}', raw_r)
       || '). Note: This indicates a statistical association and does not imply causation.' AS explanation
FROM significant
""")
def corr_pairs_lineitem(spark, sf_dir):
    pairs = stats.correlations(sales_lines(spark, sf_dir), VALUE_COLUMNS)
    return stats.explained(stats.significant_pairs(pairs)).drop("order_a", "order_b")


@query(f"""
WITH {SALES_LINES_SQL}, {pairs_sql('sales_lines', VALUE_COLUMNS)}
SELECT direction, a AS column_a, b AS column_b, correlation, strength FROM (
  SELECT CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, a, b, round(r, 3) AS correlation,
         CASE WHEN abs(r) >= 0.6 THEN 'strong' ELSE 'moderate' END AS strength,
         row_number() OVER (PARTITION BY r > 0 ORDER BY abs(round(r, 3)) DESC, oa, ob) AS k
  FROM pairs WHERE oa < ob AND abs(r) >= 0.35) WHERE k = 1
""")
def corr_strongest_lineitem(spark, sf_dir):
    return stats.strongest(stats.correlations(sales_lines(spark, sf_dir), VALUE_COLUMNS))


@query(f"""
WITH {SALES_LINES_SQL}, {pairs_sql('sales_lines', VALUE_COLUMNS)},
both_ways AS (SELECT a AS driver, b AS target, r, oa, ob FROM pairs WHERE oa < ob UNION ALL SELECT b, a, r, ob, oa FROM pairs WHERE oa < ob)
SELECT driver, target, round(r, 2) AS correlation, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS relationship
FROM both_ways ORDER BY abs(round(r, 2)) DESC, oa, ob LIMIT 8
""")
def whatif_options(spark, sf_dir):
    return stats.what_if_options(stats.correlations(sales_lines(spark, sf_dir), VALUE_COLUMNS))


@query("""
SELECT count(*) AS n, round(covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity), 6) AS slope,
       round(avg(l_extendedprice) - covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) * avg(l_quantity), 4) AS intercept,
       round(covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)), 4) AS r,
       round(power(covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)), 2), 4) AS r_squared
FROM lineitem
""")
def regression_quantity_price(spark, sf_dir):
    return stats.regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


def _what_if_sql(source: str, x: str, y: str, pct: float) -> str:
    factor = 1 + pct / 100
    return f"""
, m AS (SELECT count(*) AS n, sum({x}) AS sx, sum({y}) AS sy, covar_pop({x}, {y}) / var_pop({x}) AS slope,
               covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) AS r, avg({x}) AS ax, avg({y}) AS ay FROM {source}),
e AS (SELECT *, slope * {factor} * sx + n * (ay - slope * ax) AS sim FROM m)
SELECT TRUE AS success, '{x}' AS driver_column, '{y}' AS target_column, CAST({pct} AS DOUBLE) AS percentage_change,
       round(sx / n, 2) AS current_driver_mean, round(sx / n * {factor}, 2) AS simulated_driver_mean, round(sy, 2) AS current_target_value,
       round(sim, 2) AS simulated_target_value, round(sim - sy, 2) AS estimated_change, round(100 * (sim - sy) / sy, 2) AS percentage_change_result,
       round(r, 3) AS correlation, round(r * r, 3) AS r_squared, CAST(least(95, greatest(40, floor(r * r * 100))) AS INTEGER) AS confidence_score,
       'If {x} experiences a {abs(pct)}% {'increase' if pct > 0 else 'decrease'}, {y} is projected to '
       || CASE WHEN sim - sy > 0 THEN 'increase' ELSE 'decrease' END || ' by approximately ' || format('{{:.1f}}', abs(100 * (sim - sy) / sy))
       || '% (' || CASE WHEN sim - sy >= 0 THEN '+' ELSE '-' END || format('{{:,.2f}}', abs(sim - sy)) || ' total change, r = ' || format('{{:.2f}}', r) || ').' AS summary,
       NULL::VARCHAR AS error
FROM e
"""


@query(f"WITH {SALES_LINES_SQL} {_what_if_sql('sales_lines', 'l_extendedprice', 'revenue', 10.0)}")
def whatif_price_revenue(spark, sf_dir):
    return stats.what_if(sales_lines(spark, sf_dir), "l_extendedprice", "revenue", 10.0)


@query(f"WITH {SALES_LINES_SQL} {_what_if_sql('sales_lines', 'l_discount', 'charge', -25.0)}")
def whatif_discount_charge(spark, sf_dir):
    return stats.what_if(sales_lines(spark, sf_dir), "l_discount", "charge", -25.0)


# ---- headline numbers ---------------------------------------------------------------

_MONTHS_ORDERS = months_sql("orders", "o_orderdate", ["o_orderkey", "o_custkey", "o_totalprice"])
_GROWTH_SQL = """
ends AS (SELECT col_order, col, count(*) AS months, first(v ORDER BY month) AS a, first(v ORDER BY month DESC) AS b FROM months WHERE v <> 0 GROUP BY ALL),
growth AS (SELECT col_order, col AS "column", months, round(100 * (b - a) / a, 1) AS growth_pct FROM ends WHERE months >= 2)
"""


@query(f"WITH {_MONTHS_ORDERS}, {_GROWTH_SQL} SELECT * FROM growth")
def growth_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return growth(monthly_sums(df, F.col("o_orderdate"), ["o_orderkey", "o_custkey", "o_totalprice"]))


@query(f"""
WITH {_MONTHS_ORDERS}, {_GROWTH_SQL},
k AS (SELECT CAST(sum(o_orderkey) AS DOUBLE) AS total, avg(o_custkey) AS mean FROM orders)
SELECT CAST(1 AS INTEGER) AS position, 'Total o_orderkey' AS label, 'Cumulative Aggregation' AS sub_label,
       CASE WHEN abs(total) >= 1e6 THEN format('{{:.2f}}M', total / 1e6) ELSE format('{{:,.2f}}', total) END AS value FROM k
UNION ALL SELECT 2, 'Average o_custkey', 'Mean Observation', format('{{:,.2f}}', mean) FROM k
UNION ALL SELECT 3, 'Data Quality Score', 'Automated Hygiene', '96.7%'
UNION ALL SELECT 4, 'Net Period Growth', 'Across o_orderdate', CASE WHEN growth_pct >= 0 THEN '+' ELSE '-' END || format('{{:,.1f}}', abs(growth_pct)) || '%' FROM growth WHERE col_order = 0
""")
def kpi_row_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return kpi.kpis(df, profile.infer_types(df))


@query("""
SELECT o_orderstatus AS top_category, 'o_orderstatus' AS group_column, 'o_totalprice' AS metric_label, round(sum(o_totalprice), 2) AS value
FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 1
""")
def leader_ranking(spark, sf_dir):
    return charts.leader(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")


# ---- chart choice --------------------------------------------------------------------


@query(f"""
WITH {SALES_LINES_SQL}, {pairs_sql('sales_lines', VALUE_COLUMNS)}, {SIGNIFICANT_SQL}, best AS (SELECT * FROM significant ORDER BY abs(correlation) DESC, oa, ob LIMIT 1)
SELECT CAST(1 AS INTEGER) AS chart_order, 'line' AS type, 'l_shipdate' AS x, 'l_quantity,l_extendedprice' AS y, 'Performance Trend Over Time' AS title, CAST(0.98 AS DOUBLE) AS importance
UNION ALL SELECT 2, 'bar', 'l_returnflag', 'l_quantity', 'l_quantity by l_returnflag', 0.88
UNION ALL SELECT 3, 'horizontal_bar', 'l_extendedprice', 'l_linestatus', 'Top Rankings: l_extendedprice by l_linestatus', 0.82
UNION ALL SELECT 4, 'histogram', 'l_quantity', 'count', 'Distribution: l_quantity', 0.78
UNION ALL SELECT 5, 'box_plot', 'l_extendedprice', 'l_extendedprice', 'Quartile Spread: l_extendedprice', 0.74
UNION ALL SELECT 6, 'heatmap', NULL, '', 'Correlation Matrix Heatmap', 0.72
UNION ALL SELECT 7, 'pie', 'l_linestatus', 'l_quantity', 'Proportion of l_quantity by l_linestatus', 0.68
UNION ALL SELECT 8, 'scatter', column_a, column_b, column_a || ' vs ' || column_b || ' (r = ' || CASE WHEN correlation >= 0 THEN '+' ELSE '-' END
       || format('{{:.2f}}', abs(correlation)) || ')', 0.65 FROM best WHERE abs(correlation) >= 0.45
""")
def chart_specs(spark, sf_dir):
    df = sales_lines(spark, sf_dir)
    types = profile.infer_types(df)
    pairs = stats.significant_pairs(stats.correlations(df, types.numerical))
    return recommend.spec_frame(spark, recommend.recommend(types, recommend.best_pair(pairs)))


@query(f"""
WITH {SALES_LINES_SQL}
SELECT round(l_extendedprice, 2) AS x, round(revenue, 2) AS y FROM sales_lines
ORDER BY md5(row_id || ':{charts.SAMPLE_SEED}'), row_id LIMIT {charts.SCATTER_POINTS}
""")
def scatter_sample(spark, sf_dir):
    return charts.scatter(sales_lines(spark, sf_dir), "l_extendedprice", "revenue")


# ---- sliced rows ---------------------------------------------------------------------

ACTIVE = {"event_type": " Click ", "value": [1, 200]}
SLICED_SQL = "sliced AS (SELECT * FROM events WHERE lower(trim(event_type)) = 'click' AND value BETWEEN 1 AND 200)"


def _sliced(spark, sf_dir):
    return filters.apply_slicers(table(spark, sf_dir, "events", ids=True), ACTIVE)


def _slicer_bar_sql(k: int, width: int) -> str:
    return (
        f"WITH {SLICED_SQL}, g AS (SELECT coalesce(props, 'Unknown') AS label, round(sum(coalesce(value, 0)), 2) AS value FROM sliced GROUP BY 1) "
        f"SELECT substr(label, 1, {width}) AS label, value FROM (SELECT * FROM g ORDER BY value DESC, label LIMIT {k})"
    )


@query(_slicer_bar_sql(8, 18))
def slicer_recompute_bar(spark, sf_dir):
    return slicer.bar(_sliced(spark, sf_dir), "props", "value")


@query(_slicer_bar_sql(8, 18))
def slicer_recompute_ranking(spark, sf_dir):
    return slicer.ranking(_sliced(spark, sf_dir), "props", "value")


@query(_slicer_bar_sql(6, 15))
def slicer_recompute_pie(spark, sf_dir):
    return slicer.pie(_sliced(spark, sf_dir), "props", "value")


@query(f"""
WITH {SLICED_SQL}, h AS (SELECT min(value) AS lo, max(value) AS hi, least(8, greatest(4, CAST(floor(sqrt(count(*))) AS INTEGER))) AS bins FROM sliced),
w AS (SELECT *, coalesce(nullif((hi - lo) / bins, 0), 1) AS width FROM h),
c AS (SELECT CAST(least(bins - 1, floor((value - lo) / width)) AS INTEGER) AS bin, count(*) AS n FROM sliced, w GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * width) AS left_edge, round(lo + (b + 1) * width) AS right_edge, coalesce(n, 0) AS count
FROM w, generate_series(0, 7) g(b) LEFT JOIN c ON c.bin = b WHERE b < bins
""")
def slicer_recompute_hist(spark, sf_dir):
    return slicer.histogram(_sliced(spark, sf_dir), "value")


@query(f"""
WITH {SLICED_SQL}, r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM sliced),
q AS (SELECT max(value) FILTER (WHERE k = floor(n * 0.25)) AS q1, max(value) FILTER (WHERE k = floor(n * 0.5)) AS q2, max(value) FILTER (WHERE k = floor(n * 0.75)) AS q3 FROM r)
SELECT 'value' AS metric, min(value) AS min, q1, q2 AS median, q3, max(value) AS max, round(avg(value), 2) AS mean,
       count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count
FROM sliced, q GROUP BY q1, q2, q3
""")
def slicer_recompute_box(spark, sf_dir):
    return slicer.box(_sliced(spark, sf_dir), "value")


@query(f"WITH {SLICED_SQL} SELECT strftime(ts, '%Y-%m') AS date, round(sum(coalesce(value, 0)), 2) AS value FROM sliced GROUP BY 1")
def slicer_recompute_line(spark, sf_dir):
    return slicer.line(_sliced(spark, sf_dir), F.col("ts"), ["value"])


@query(f"WITH {SLICED_SQL} SELECT 'value' AS measure, round(sum(value), 2) AS total, count(*) AS filtered_rows FROM sliced")
def slicer_recompute_kpi(spark, sf_dir):
    return slicer.kpis(_sliced(spark, sf_dir), "value")


@query(f"WITH {SLICED_SQL} SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM sliced WHERE user_id IS NOT NULL AND value IS NOT NULL ORDER BY event_id LIMIT 60")
def slicer_recompute_scatter(spark, sf_dir):
    return slicer.scatter(_sliced(spark, sf_dir), "user_id", "value")


