"""Queries over written and re-read tables, and the whole dashboard."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sheetlens.operators import charts, clean, domain, profile
from sheetlens.plans import analysis
from sheetlens.plans.queries.cleaning import REPORT_SQL
from sheetlens.plans.queries.registry import messy_lineitem, query, sales_lines, table
from sheetlens.session import new_path
from sheetlens.sources import csv, tables
from sheetlens.sources.row_ids import with_row_id


@query("SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def csv_roundtrip(spark, sf_dir):
    out = tables.export_csv(table(spark, sf_dir, "part"), new_path(spark, "export"), "part.csv")
    return csv.read_csv(spark, out).drop("_row_id")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip_documents(spark, sf_dir):
    """Texts with line breaks, quotes and blanks."""
    out = tables.export_csv(table(spark, sf_dir, "documents"), new_path(spark, "export"), "documents.csv")
    return csv.read_csv(spark, out).drop("_row_id")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
       'datetime' AS date_class FROM orders
""")
def csv_roundtrip_orders(spark, sf_dir):
    """Dates come back as text of class datetime."""
    out = tables.export_csv(table(spark, sf_dir, "orders"), new_path(spark, "export"), "orders.csv")
    back = csv.read_csv(spark, out).drop("_row_id")
    kind = "datetime" if "o_orderdate" in profile.infer_types(back).dates else "other"
    return back.withColumn("date_class", F.lit(kind))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def cleaned_reload(spark, sf_dir):
    cleaned, _ = clean.clean(table(spark, sf_dir, "orders", ids=True))
    return tables.save_cleaned(cleaned, new_path(spark, "saved")).drop("_row_id")


@query(REPORT_SQL + """
SELECT 'lines' AS dataset_id, 'ana' AS owner, 'lines.csv' AS filename, rows_after AS row_count, CAST(6 AS INTEGER) AS column_count,
       CAST(5 AS INTEGER) AS numerical_columns, CAST(1 AS INTEGER) AS categorical_columns, CAST(0 AS INTEGER) AS date_columns,
       CAST(missing_before AS BIGINT) AS missing_values, (SELECT count(*) FROM messy_lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy_lineitem)) AS duplicate_rows,
       'sales' AS dataset_domain, round(0.45 * comp + 0.35 * dup + 0.20 * cons, 1) AS quality_score
FROM s
""")
def dataset_listing(spark, sf_dir):
    base = new_path(spark, "datasets")
    raw = with_row_id(messy_lineitem(spark, sf_dir))
    cleaned, report = clean.clean(raw)
    types = profile.infer_types(cleaned)
    copies = profile.duplicate_rows(raw).first()[0]
    kind = domain.classify_domain(domain.domain_scores(cleaned)).first()["domain"]
    for owner, hour in (("ana", 1), ("ben", 2)):
        made = dt.datetime(2024, 1, 1, hour)
        tables.append_dataset(tables.dataset_row(spark, "lines", "lines.csv", types, report, copies, kind, made, owner), base)
    return tables.list_datasets(tables.read_datasets(spark, base), "ana").drop("created_at")


@query("""
SELECT 'orders' AS dataset_id, substr(label, 1, 18) AS label, round(v, 2) AS value
FROM (SELECT o_orderpriority AS label, sum(o_totalprice) AS v FROM orders GROUP BY 1)
""")
def stored_results(spark, sf_dir):
    base = new_path(spark, "results")
    bars = charts.bar(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    for dataset in ("orders", "other"):
        tables.append_result(bars, base, "bars", dataset)
    return tables.read_result(spark, base, "bars", "orders")


@query("SELECT o_orderpriority AS dashboard_id, round(sum(o_totalprice), 2) AS value, CAST(2 AS BIGINT) AS version FROM orders GROUP BY 1")
def versioned_results(spark, sf_dir):
    base = new_path(spark, "dashboards")
    totals = charts.group_totals(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    rows = totals.select(F.col("label").alias("dashboard_id"), F.round("value", 2).alias("value"))
    tables.store_version(rows, base)
    tables.store_version(rows, base)
    return tables.read_dashboard(spark, base)


@query()
def dashboard_bundle(spark, sf_dir):
    return analysis.dashboard(sales_lines(spark, sf_dir), "lines")
