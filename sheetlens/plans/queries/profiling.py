"""Queries over column types, profiles, filters, search and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlens.functions.counts import union_all
from sheetlens.functions.dates import parsed_date
from sheetlens.operators import domain, filters, kpi, profile
from sheetlens.plans.queries.registry import (
    MESSY_LINEITEM_SQL,
    TEXT_ORDERS_SQL,
    messy_lineitem,
    query,
    table,
    text_orders,
    types_sql,
    union,
)

LINEITEM = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]
EVENTS = [
    ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
    ("value", "double"), ("props", "string"),
]
DOCUMENTS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
MESSY = [("l_orderkey", "bigint"), ("l_linenumber", "int"), ("qty", "double"), ("flag", "string"), ("price_text", "string"), ("disc_text", "string")]


@query(types_sql("lineitem", LINEITEM))
def profile_columns_lineitem(spark, sf_dir):
    return profile.column_types(table(spark, sf_dir, "lineitem"))


@query(types_sql("events", EVENTS))
def profile_columns_events(spark, sf_dir):
    return profile.column_types(table(spark, sf_dir, "events"))


@query(types_sql("documents", DOCUMENTS))
def profile_columns_documents(spark, sf_dir):
    return profile.column_types(table(spark, sf_dir, "documents"))


@query(f"WITH {MESSY_LINEITEM_SQL} {types_sql('messy_lineitem', MESSY)}")
def profile_columns_messy(spark, sf_dir):
    return profile.column_types(messy_lineitem(spark, sf_dir))


@query(f"SELECT sem_type, count(*) AS column_count FROM ({types_sql('lineitem', LINEITEM)}) GROUP BY 1")
def class_counts_lineitem(spark, sf_dir):
    return profile.class_counts(profile.column_types(table(spark, sf_dir, "lineitem")))


def _stats_sql(source: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", round(avg({c}), 2) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS median, "
            f"round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max, "
            f"round(CAST(sum({c}) AS DOUBLE), 2) AS sum, format('{{:,.2f}} – {{:,.2f}}', CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE)) AS \"range\" FROM {source}"
            for c in columns
        ]
    )


ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


@query(_stats_sql("orders", ORDER_NUMBERS))
def numeric_stats_orders(spark, sf_dir):
    return profile.numeric_stats(table(spark, sf_dir, "orders"), ORDER_NUMBERS)


def _top_sql(source: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count, "
            f"CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"
            for c in columns
        ]
    )


@query(_top_sql("customer", ["c_name", "c_mktsegment"]))
def top_categories_customer(spark, sf_dir):
    return profile.top_categories(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@query(_top_sql("part", ["p_name", "p_brand", "p_type"]))
def top_categories_part(spark, sf_dir):
    return profile.top_categories(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@query("""
SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS min, strftime(max(o_orderdate), '%Y-%m-%d') AS max,
       strftime(min(o_orderdate), '%Y-%m-%d') || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d') AS "range",
       CASE WHEN count(*) < 2 THEN 'Single Date'
            WHEN floor(date_diff('second', min(o_orderdate), max(o_orderdate)) / 86400) / greatest(1, count(*) - 1) <= 2 THEN 'Daily'
            WHEN floor(date_diff('second', min(o_orderdate), max(o_orderdate)) / 86400) / greatest(1, count(*) - 1) <= 10 THEN 'Weekly'
            WHEN floor(date_diff('second', min(o_orderdate), max(o_orderdate)) / 86400) / greatest(1, count(*) - 1) <= 45 THEN 'Monthly'
            ELSE 'Yearly' END AS granularity
FROM orders
""")
def datetime_stats_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return profile.datetime_stats(df, profile.infer_types(df))


@query(f"""
WITH {MESSY_LINEITEM_SQL}
SELECT (SELECT count(*) FROM messy_lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy_lineitem)) AS duplicate_rows
""")
def duplicate_rows_messy(spark, sf_dir):
    return profile.duplicate_rows(messy_lineitem(spark, sf_dir))


@query(f"""
WITH {MESSY_LINEITEM_SQL}
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(6 AS INTEGER) AS column_count,
       CAST(2 * count(*) - count(qty) - count(flag) AS BIGINT) AS missing_values,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy_lineitem)) AS duplicate_rows,
       'l_orderkey,l_linenumber,qty' AS numerical_columns, 'flag,price_text,disc_text' AS categorical_columns
FROM messy_lineitem
""")
def table_profile_messy(spark, sf_dir):
    row = profile.table_profile(messy_lineitem(spark, sf_dir))
    sizes = ["row_count", "column_count", "missing_values", "duplicate_rows"]
    return row.select(*sizes, *[F.array_join(c, ",").alias(c) for c in ("numerical_columns", "categorical_columns")])


def _samples_sql(source: str, key: str, columns: list[tuple[str, str]]) -> str:
    return union(
        [
            f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY {key}) AS INTEGER) AS position, "
            f"{cast} AS value FROM {source} WHERE {c} IS NOT NULL) WHERE position <= 5"
            for c, cast in columns
        ]
    )


@query(
    _samples_sql(
        "part",
        "p_partkey",
        [(c, f"CAST({c} AS VARCHAR)") for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")],
    )
)
def sample_values_part(spark, sf_dir):
    return profile.sample_values(table(spark, sf_dir, "part", ids=True))


@query(f"""
WITH {TEXT_ORDERS_SQL}
SELECT 'order_date_text' AS "column", count(order_date_text) AS present, count(try_strptime(order_date_text, '%Y-%m-%d')) AS hits,
       round(count(try_strptime(order_date_text, '%Y-%m-%d')) / count(order_date_text), 4) AS hit_rate,
       count(try_strptime(order_date_text, '%Y-%m-%d')) >= 0.8 * count(order_date_text) AS is_date,
       CASE WHEN count(try_strptime(order_date_text, '%Y-%m-%d')) >= 0.8 * count(order_date_text) THEN 'yyyy-MM-dd' END AS date_format
FROM text_orders
""")
def date_detect(spark, sf_dir):
    return profile.date_detection(text_orders(spark, sf_dir), ["order_date_text"])


# column, layout as written, the same for DuckDB, the part of the time that is kept, zone behind it
WRITTEN = (
    ("iso_fraction", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "%Y-%m-%dT%H:%M:%S.%f", "microsecond", ""),
    ("iso_zone", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "second", "+02:00"),
    ("iso_short_zone", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "second", "-0130"),
    ("month_name", "d-MMM-yyyy", "%-d-%b-%Y", "day", ""),
    ("month_first", "M/d/yyyy H:mm", "%-m/%-d/%Y %-H:%M", "minute", ""),
    ("day_first", "d/M/yyyy", "%-d/%-m/%Y", "day", ""),
    ("twelve_hours", "M/d/yyyy h:mm a", "%-m/%-d/%Y %-I:%M %p", "minute", ""),
    ("month_only", "MMM yyyy", "%b %Y", "month", ""),
    ("compact", "yyyyMMdd", "%Y%m%d", "day", ""),
    ("long_month", "MMMM d, yyyy", "%B %-d, %Y", "day", ""),
)
# what is found where it is not the layout as written
FOUND = {
    "iso_fraction": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]", "iso_zone": "yyyy-MM-dd HH:mm:ssXXX", "iso_short_zone": "yyyy-MM-dd'T'HH:mm:ssXX",
}
HOURS_AHEAD = {"+02:00": "INTERVAL 120 MINUTE", "-0130": "INTERVAL (-90) MINUTE", "": "INTERVAL 0 MINUTE"}


def _written_sql(name: str, layout: str, form: str, unit: str, zone: str) -> str:
    found = FOUND.get(name, layout).replace("'", "''")
    time = f"date_trunc('{unit}', ts) - {HOURS_AHEAD[zone]}"
    text = f"CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '{form}') || '{zone}' END"
    return f"""SELECT '{name}' AS "column", count({text}) AS present, count(DISTINCT {text}) AS n_values, count({text}) AS hits, CAST(1.0 AS DOUBLE) AS hit_rate,
       true AS is_date, '{found}' AS date_format, min({time}) FILTER (event_id % 9 <> 0) AS first_time, max({time}) FILTER (event_id % 9 <> 0) AS last_time FROM events"""


@query(" UNION ALL ".join(_written_sql(*w) for w in WRITTEN))
def date_layouts(spark, sf_dir):
    """The events' times written in ten layouts, some missing: the layout found for each, and the first and last time read with it."""
    events = table(spark, sf_dir, "events").where("event_id % 9 <> 0")
    texts = events.select(*(F.concat(F.date_format("ts", layout), F.lit(zone)).alias(name) for name, layout, _, _, zone in WRITTEN))
    found = profile.date_detection(texts, texts.columns)
    layouts = {r["column"]: r["date_format"] for r in found.select("column", "date_format").collect()}
    times = [F.struct(F.lit(c).alias("column"), F.count_distinct(F.col(c)).alias("n_values"), F.min(t).alias("first_time"), F.max(t).alias("last_time")) for c, layout in layouts.items() if layout for t in [parsed_date(F.col(c), layout)]]
    return found.join(texts.agg(F.array(*times).alias("t")).select(F.inline("t")), "column")


# ---- domain ------------------------------------------------------------------

DOMAIN_TABLES = {
    "customer": ("c_custkey", "c_custkey c_name c_nationkey c_acctbal c_mktsegment", ["c_name", "c_mktsegment"]),
    "orders": ("o_orderkey", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", ["o_orderstatus", "o_orderpriority"]),
    "part": ("p_partkey", "p_partkey p_name p_brand p_type p_size p_retailprice", ["p_name", "p_brand", "p_type"]),
}


def _domain_sql() -> str:
    words = ", ".join(
        f"({i}, '{key}', '{title.replace(chr(39), chr(39) * 2)}', '{w}')"
        for i, (key, title, keywords) in enumerate(domain.DOMAINS)
        for w in keywords
    )
    texts = []
    for name, (_, names, columns) in DOMAIN_TABLES.items():
        values = " || ' ' || ".join(f"coalesce({c}, '')" for c in columns)
        texts.append(f"SELECT '{name}' AS table_name, '{names}' AS names, lower(string_agg(DISTINCT {values}, ' ')) AS txt FROM {name}")
    return (
        f"WITH words(domain_order, domain, domain_name, word) AS (VALUES {words}), texts AS ({union(texts)}), "
        "scores AS (SELECT table_name, CAST(domain_order AS INTEGER) AS domain_order, domain, domain_name, "
        "CAST(2 * count(*) FILTER (WHERE contains(names, word)) AS INTEGER) AS name_score, "
        "CAST(count(*) FILTER (WHERE contains(txt, word)) AS INTEGER) AS value_score FROM texts, words GROUP BY ALL)"
    )


def _each_domain_table(spark, sf_dir, make):
    return union_all([make(table(spark, sf_dir, n, ids=True)).withColumn("table_name", F.lit(n)) for n in DOMAIN_TABLES])


@query(_domain_sql() + " SELECT *, name_score + value_score AS score FROM scores")
def domain_scores(spark, sf_dir):
    return _each_domain_table(spark, sf_dir, domain.domain_scores)


@query(_domain_sql() + """
, ranked AS (SELECT *, name_score + value_score AS s, row_number() OVER (PARTITION BY table_name ORDER BY name_score + value_score DESC, domain_order) AS k FROM scores)
SELECT table_name, CASE WHEN s >= 1 THEN domain ELSE 'general' END AS domain,
       CASE WHEN s >= 1 THEN domain_name ELSE 'General Structured Dataset' END AS domain_name,
       CAST(CASE WHEN s >= 4 THEN least(96, 75 + 3 * s) WHEN s >= 2 THEN 78 WHEN s >= 1 THEN 62 ELSE 52 END AS INTEGER) AS confidence,
       CAST(s AS BIGINT) AS score
FROM ranked WHERE k = 1
""")
def domain_class(spark, sf_dir):
    return _each_domain_table(spark, sf_dir, lambda df: domain.classify_domain(domain.domain_scores(df)))


# ---- filters, search, pages ----------------------------------------------------

ORDERS_OUT = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
ORDERS_COLUMNS = ORDERS_OUT.split(", ")


def _filtered(spark, sf_dir, active, apply=filters.apply_filters):
    return apply(table(spark, sf_dir, "orders"), active).select(*ORDERS_COLUMNS)


@query(f"SELECT {ORDERS_OUT} FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM'")
def filter_apply_eq(spark, sf_dir):
    return _filtered(spark, sf_dir, {"o_orderstatus": "F", "o_orderpriority": "3-MEDIUM", "no_such_column": 1, "o_custkey": "all"})


@query(f"SELECT {ORDERS_OUT} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_apply_in(spark, sf_dir):
    return _filtered(spark, sf_dir, {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": []})


@query(f"SELECT {ORDERS_OUT} FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000")
def filter_apply_range(spark, sf_dir):
    return _filtered(spark, sf_dir, {"o_totalprice": {"min": 100000, "max": 200000}, "o_custkey": {"min": None}})


@query(f"SELECT {ORDERS_OUT} FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'")
def filter_apply_date(spark, sf_dir):
    return _filtered(spark, sf_dir, {"o_orderdate": ["1996-01-01", "1996-06-30"]}, filters.apply_slicers)


@query(f"SELECT {ORDERS_OUT} FROM orders WHERE lower(trim(o_orderpriority)) = '1-urgent' AND o_totalprice >= 50000")
def filter_apply_ci_eq(spark, sf_dir):
    active = {"o_orderpriority": " 1-urgent ", "o_totalprice": [50000, ""], "o_orderstatus": "All"}
    return _filtered(spark, sf_dir, active, filters.apply_slicers)


@query("""
SELECT TRUE AS has_filters, count(*) AS active_rows, ' (' || format('{:,}', count(*)) || ' records after active filters)' AS suffix
FROM orders WHERE o_orderstatus = 'O'
""")
def filter_status_orders(spark, sf_dir):
    return filters.filter_status(table(spark, sf_dir, "orders"), {"o_orderstatus": "O"})


PART_TEXT = "concat_ws(chr(1), CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR))"


@query(f"SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE contains(lower({PART_TEXT}), 'brand#1')")
def search_rows_part(spark, sf_dir):
    return filters.search_rows(table(spark, sf_dir, "part"), "BRAND#1")


_PAGE_COLUMNS = "CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice"


@query(f"SELECT {_PAGE_COLUMNS} FROM part WHERE contains(lower({PART_TEXT}), 'ring') ORDER BY part.p_partkey LIMIT 20 OFFSET 20")
def page_search_part(spark, sf_dir):
    return filters.page_rows(table(spark, sf_dir, "part", ids=True), 2, 20, "Ring").drop("_row_id")


@query(f"SELECT {_PAGE_COLUMNS} FROM part ORDER BY part.p_partkey LIMIT 50 OFFSET 100")
def page_rows_part(spark, sf_dir):
    return filters.page_rows(table(spark, sf_dir, "part", ids=True), 3, 50).drop("_row_id")


_LINE_COLUMNS = ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
)


@query(f"""
WITH placed AS (SELECT *, row_number() OVER () - 1 AS place, count(*) OVER () AS total FROM lineitem)
SELECT {_LINE_COLUMNS} FROM placed WHERE place >= (total - 1) // 50 * 50
""")
def page_rows_deep(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", ids=True)
    return filters.page_at(df, filters.page_index(df)).drop("_row_id")


@query(f"""
WITH hits AS (SELECT *, row_number() OVER () - 1 AS place FROM (SELECT *, row_number() OVER () AS at FROM lineitem) WHERE contains(l_shipdate::VARCHAR, '1995-03'))
SELECT {_LINE_COLUMNS} FROM hits WHERE place >= 40 AND place < 60
""")
def page_search_deep(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", ids=True)
    return filters.page_at(df, filters.page_index(df, "1995-03"), 3, 20, "1995-03").drop("_row_id")


@query("""
SELECT CAST(2 AS INTEGER) AS filter_order, 'o_orderstatus' AS "column", 'categorical' AS filter_type, CAST(to_json(list(v ORDER BY v)) AS VARCHAR) AS options, NULL::VARCHAR AS low, NULL::VARCHAR AS high
FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)
UNION ALL SELECT 5, 'o_orderpriority', 'categorical', CAST(to_json(list(v ORDER BY v)) AS VARCHAR), NULL, NULL FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)
UNION ALL SELECT 6, 'o_orderdate', 'date_range', NULL, strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d') FROM orders
UNION ALL SELECT 7, 'o_orderkey', 'numeric_range', NULL, format('{:.2f}', CAST(min(o_orderkey) AS DOUBLE)), format('{:.2f}', CAST(max(o_orderkey) AS DOUBLE)) FROM orders
UNION ALL SELECT 8, 'o_custkey', 'numeric_range', NULL, format('{:.2f}', CAST(min(o_custkey) AS DOUBLE)), format('{:.2f}', CAST(max(o_custkey) AS DOUBLE)) FROM orders
UNION ALL SELECT 9, 'o_totalprice', 'numeric_range', NULL, format('{:.2f}', min(o_totalprice)), format('{:.2f}', max(o_totalprice)) FROM orders
""")
def filter_catalogue_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    # the list of options as JSON text, so that values can hold any sign
    return kpi.filter_catalogue(df, profile.infer_types(df)).withColumn("options", F.to_json("options"))
