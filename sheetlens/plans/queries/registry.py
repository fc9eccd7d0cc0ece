"""Where queries and their SQL are kept, and the derived tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.operators import profile
from sheetlens.sources.row_ids import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, ids: bool = False) -> DataFrame:
    """A driver table, with row ids where row order or identity matters."""
    path = f"{sf_dir}/{name}.parquet"
    return read_parquet(spark, path) if ids else spark.read.parquet(path)


# ---- line items with the amounts that follow from them -------------------------------

VALUE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "revenue", "charge", "tax_amount"]

SALES_LINES_SQL = """
sales_lines AS (
  SELECT l_returnflag, l_linestatus, l_shipdate, l_quantity, l_extendedprice, l_discount,
         l_extendedprice * (1 - l_discount) AS revenue,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
         l_extendedprice * (1 - l_discount) * l_tax AS tax_amount,
         row_number() OVER () - 1 AS row_id
  FROM lineitem)
"""


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem", ids=True).select(
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        revenue.alias("revenue"),
        (revenue * (1 + F.col("l_tax"))).alias("charge"),
        (revenue * F.col("l_tax")).alias("tax_amount"),
        "_row_id",
    )


# ---- faulty tables: missing values, copies, numbers and dates as text ----------------------

MESSY_LINEITEM_SQL = """
messy_once AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_discount > 0 THEN l_quantity END AS qty,
         CASE WHEN l_tax > 0 THEN l_returnflag END AS flag,
         '$' || format('{:,.2f}', l_extendedprice) AS price_text,
         CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) || '%' AS disc_text,
         l_quantity
  FROM lineitem),
messy_lineitem AS (
  SELECT l_orderkey, l_linenumber, qty, flag, price_text, disc_text FROM messy_once
  UNION ALL
  SELECT l_orderkey, l_linenumber, qty, flag, price_text, disc_text FROM messy_once WHERE l_quantity = 50)
"""


def messy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("qty"),
        F.when(F.col("l_tax") > 0, F.col("l_returnflag")).alias("flag"),
        F.format_string("$%,.2f", "l_extendedprice").alias("price_text"),
        F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("disc_text"),
        "l_quantity",
    )
    return once.unionByName(once.where(F.col("l_quantity") == 50)).drop("l_quantity")


MESSY_CUSTOMER_SQL = """
messy_customer AS (
  SELECT c_custkey,
         CASE WHEN c_acctbal < 2000 THEN lower(c_mktsegment)
              WHEN c_acctbal < 4000 THEN c_mktsegment || ' '
              WHEN c_acctbal < 6000 THEN '  ' || lower(c_mktsegment)
              ELSE c_mktsegment END AS segment
  FROM customer)
"""


def messy_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    return table(spark, sf_dir, "customer", ids=True).select(
        "c_custkey",
        F.when(balance < 2000, F.lower(s))
        .when(balance < 4000, F.concat(s, F.lit(" ")))
        .when(balance < 6000, F.concat(F.lit("  "), F.lower(s)))
        .otherwise(s)
        .alias("segment"),
        "_row_id",
    )


TEXT_ORDERS_SQL = """
text_orders AS (
  SELECT o_orderkey, o_totalprice,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'unknown'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date_text
  FROM orders)
"""


def text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(odd, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date_text"),
    )


# ---- SQL that several queries share ---------------------------------------------


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def types_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """Column classes of a table whose columns are (name, Spark type), by the typing rules."""
    parts = []
    for i, (name, kind) in enumerate(columns):
        n, d = "count(*)", f"count(DISTINCT {name})"
        is_id = str(profile.is_id_name(name)).upper()
        id_rule = f"WHEN {is_id} AND {d} >= 0.9 * {n} THEN 'id'"
        if kind.startswith("timestamp"):
            sem = "'datetime'"
        elif kind == "string":
            sem = (
                f"CASE WHEN count(try_strptime({name}, '%Y-%m-%d')) >= 0.8 * count({name}) THEN 'datetime' {id_rule} "
                f"WHEN {d} > greatest(50, 0.5 * {n}) AND avg(length({name})) > 30 THEN 'text' ELSE 'categorical' END"
            )
        else:
            sem = f"CASE {id_rule} WHEN {d} <= 1 THEN 'categorical' ELSE 'numerical' END"
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS col_order, '{name}' AS \"column\", {sem} AS sem_type, '{kind}' AS storage_type, "
            f"{n} - count({name}) AS missing_count, round(100.0 * ({n} - count({name})) / {n}, 2) AS missing_pct, "
            f"{d} AS unique_count FROM {source}"
        )
    return union(parts)


def months_sql(source: str, ts: str, columns: list[str]) -> str:
    """CTE ``months``: (col_order, col, month, v, cnt)."""
    aggs = ", ".join(f"sum({c}) AS s{i}, count({c}) AS c{i}" for i, c in enumerate(columns))
    rows = union(
        [f"SELECT CAST({i} AS INTEGER) AS col_order, '{c}' AS col, month, CAST(s{i} AS DOUBLE) AS v, c{i} AS cnt FROM wide_months WHERE c{i} > 0" for i, c in enumerate(columns)]
    )
    return (
        f"wide_months AS (SELECT CAST(date_trunc('month', {ts}) AS DATE) AS month, {aggs} FROM {source} "
        f"WHERE {ts} IS NOT NULL GROUP BY 1), months AS ({rows})"
    )


TRENDS_SQL = """
used_months AS (
  SELECT *, row_number() OVER (PARTITION BY col ORDER BY month) - 1 AS i
  FROM (SELECT *, sum(cnt) OVER (PARTITION BY col) AS n_rows FROM months) WHERE v <> 0),
fits AS (
  SELECT col_order, col, max(n_rows) AS n_rows, count(*) AS periods,
         covar_pop(v, i) / nullif(var_pop(i), 0) AS slope,
         coalesce(covar_pop(v, i) / nullif(stddev_pop(v) * stddev_pop(i), 0), 0) AS r,
         first(v ORDER BY i) AS v_first, first(v ORDER BY i DESC) AS v_last,
         max(v) AS v_hi, min(v) AS v_lo,
         first(month ORDER BY v DESC, i) AS m_hi, first(month ORDER BY v, i) AS m_lo
  FROM used_months GROUP BY ALL),
trends AS (
  SELECT col_order, col AS "column",
         CASE WHEN abs(r) < 0.3 THEN 'stable/fluctuating' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
         round(slope, 4) AS slope, round(r * r, 3) AS r_squared,
         round(100 * (v_last - v_first) / v_first, 1) AS total_pct_change, periods AS periods_analyzed,
         strftime(m_hi, '%Y-%m') AS peak_period, round(v_hi, 2) AS peak_value,
         strftime(m_lo, '%Y-%m') AS trough_period, round(v_lo, 2) AS trough_value
  FROM fits WHERE n_rows >= 5 AND periods >= 3)
"""

CHANGES_SQL = """
month_spans AS (SELECT col_order, col, min(month) AS lo, max(month) AS hi, sum(cnt) AS n_rows FROM months GROUP BY ALL),
calendar AS (
  SELECT col_order, col, n_rows, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM month_spans),
filled AS (
  SELECT c.col_order, c.col, c.n_rows, c.month, coalesce(m.v, 0) AS v
  FROM calendar c LEFT JOIN months m ON m.col = c.col AND m.month = c.month),
changes AS (
  SELECT col_order, col, month, CAST(n_rows AS BIGINT) AS n_rows, count(*) OVER (PARTITION BY col) AS months, v,
         100 * (v - lag(v) OVER w) / nullif(lag(v) OVER w, 0) AS pct_change
  FROM filled WINDOW w AS (PARTITION BY col ORDER BY month))
"""

PERIODS_SQL = """
periods AS (
  SELECT col_order, col AS "column", strftime(month, '%B %Y') AS period, round(pct_change, 1) AS pct_change,
         CASE WHEN pct_change < 0 THEN 'decrease' ELSE 'increase' END AS direction
  FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY abs(pct_change) DESC NULLS LAST, month) AS k
        FROM changes WHERE n_rows >= 10 AND months >= 3)
  WHERE k = 1 AND abs(pct_change) >= 20)
"""


def pairs_sql(source: str, columns: list[str]) -> str:
    """CTE ``pairs``: one row per unordered pair and per diagonal entry, with r unrounded."""
    parts = []
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            b = columns[j]
            r = f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)"
            r = f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0::DOUBLE ELSE 0 END" if i == j else r
            parts.append(f"SELECT {i} AS oa, {j} AS ob, '{a}' AS a, '{b}' AS b, {r} AS r FROM {source}")
    return f"pairs AS ({union(parts)})"


SIGNIFICANT_SQL = """
significant AS (
  SELECT a AS column_a, b AS column_b, round(r, 3) AS correlation,
         CASE WHEN abs(r) >= 0.6 THEN 'strong' ELSE 'moderate' END AS strength,
         CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, oa, ob, r AS raw_r
  FROM pairs WHERE oa < ob AND abs(r) >= 0.35
  ORDER BY abs(correlation) DESC, oa, ob LIMIT 10)
"""


def bounds_sql(source: str, columns: list[str]) -> str:
    """CTE ``bounds``: count, mean, population deviation and fences per column."""
    parts = [
        f"SELECT CAST({i} AS INTEGER) AS col_order, '{c}' AS col, count({c}) AS n, avg({c}) AS mean, stddev_pop({c}) AS std, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}"
        for i, c in enumerate(columns)
    ]
    return (
        f"raw_bounds AS ({union(parts)}), bounds AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, "
        "q3 + 1.5 * (q3 - q1) AS upper_fence FROM raw_bounds WHERE n >= 10)"
    )


def outliers_sql(source: str, columns: list[str]) -> str:
    """CTE ``outliers`` over CTE ``bounds``."""
    parts = [
        f"SELECT b.col_order, b.col AS \"column\", count(*) FILTER (WHERE abs(t.{c} - b.mean) / nullif(b.std, 0) > 3) AS zscore_outliers, "
        f"count(*) FILTER (WHERE t.{c} < b.lower_fence OR t.{c} > b.upper_fence) AS iqr_outliers "
        f"FROM {source} t JOIN bounds b ON b.col = '{c}' GROUP BY ALL"
        for c in columns
    ]
    return f"outliers AS ({union(parts)})"
