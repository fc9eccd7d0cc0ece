"""Queries over the cleaning steps, one by one and together."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlens.operators import clean, profile
from sheetlens.plans.queries.registry import (
    MESSY_CUSTOMER_SQL,
    MESSY_LINEITEM_SQL,
    messy_customer,
    messy_lineitem,
    query,
)
from sheetlens.session import drop_staged, small_frame, stage
from sheetlens.sources.row_ids import with_row_id

COERCED_SQL = """
coerced AS (
  SELECT l_orderkey, l_linenumber, qty, flag,
         try_cast(replace(translate(price_text, '$€£¥₹', ''), ',', '') AS DOUBLE) AS price_text,
         try_cast(replace(disc_text, '%', '') AS DOUBLE) / 100.0 AS disc_text
  FROM messy_lineitem)
"""
ONCE_SQL = "once AS (SELECT DISTINCT * FROM coerced)"
FILL_SQL = """
fills AS (SELECT quantile_cont(qty, 0.5) AS med, count(*) - count(qty) AS qty_gone, count(*) - count(flag) AS flag_gone FROM once),
flag_mode AS (SELECT flag AS mode_flag FROM once WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1),
imputed AS (SELECT l_orderkey, l_linenumber, coalesce(qty, med) AS qty, coalesce(flag, mode_flag) AS flag, price_text, disc_text FROM once, fills, flag_mode),
cleaned AS (SELECT DISTINCT * FROM imputed)
"""


def _coerced(spark, sf_dir):
    df = with_row_id(messy_lineitem(spark, sf_dir))
    return clean.coerce_numbers(df, clean.typed_for_cleaning(df))[0]


@query(f"WITH {MESSY_LINEITEM_SQL}, {COERCED_SQL} SELECT * FROM coerced")
def clean_coerce(spark, sf_dir):
    return _coerced(spark, sf_dir).drop("_row_id")


@query(f"WITH {MESSY_CUSTOMER_SQL} SELECT c_custkey, upper(substr(trim(segment), 1, 1)) || lower(substr(trim(segment), 2)) AS segment FROM messy_customer")
def clean_normalise(spark, sf_dir):
    df = messy_customer(spark, sf_dir)
    return clean.normalise_text(df, profile.infer_types(df))[0].drop("_row_id")


@query(f"WITH {MESSY_LINEITEM_SQL} SELECT DISTINCT * FROM messy_lineitem")
def clean_dedup(spark, sf_dir):
    return clean.drop_duplicates(with_row_id(messy_lineitem(spark, sf_dir))).drop("_row_id")


def _fills(spark, sf_dir, kinds):
    # written once: classes, medians and modes take many scans of the distinct rows
    df = stage(clean.drop_duplicates(_coerced(spark, sf_dir)), "distinct")
    filled, _ = clean.fill_values(df, profile.infer_types(df, "needed"))
    drop_staged(df)
    rows = [
        {"column": c, "count": f["count"], "strategy": f["strategy"], "fill_value": str(f["fill_value"])}
        for c, f in filled.items()
        if f["strategy"] == kinds
    ]
    return small_frame(spark, rows, "column string, count bigint, strategy string, fill_value string")


@query(f"WITH {MESSY_LINEITEM_SQL}, {COERCED_SQL}, {ONCE_SQL}, {FILL_SQL} SELECT 'qty' AS \"column\", qty_gone AS count, 'the column median' AS strategy, CAST(round(med, 3) AS VARCHAR) AS fill_value FROM fills")
def clean_impute_median(spark, sf_dir):
    return _fills(spark, sf_dir, clean.MEDIAN_NOTE)


@query(f"WITH {MESSY_LINEITEM_SQL}, {COERCED_SQL}, {ONCE_SQL}, {FILL_SQL} SELECT 'flag' AS \"column\", flag_gone AS count, 'the most common value' AS strategy, mode_flag AS fill_value FROM fills, flag_mode")
def clean_impute_mode(spark, sf_dir):
    return _fills(spark, sf_dir, clean.MODE_NOTE)


@query(f"WITH {MESSY_LINEITEM_SQL}, {COERCED_SQL}, {ONCE_SQL}, {FILL_SQL} SELECT * FROM cleaned")
def clean_all_steps(spark, sf_dir):
    return clean.clean(messy_lineitem(spark, sf_dir))[0].drop("_row_id")


def _outlier_sql() -> str:
    numbers = ["l_orderkey", "l_linenumber", "qty", "price_text", "disc_text"]
    parts = [
        f"(SELECT count(*) FROM cleaned, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM cleaned) "
        f"WHERE q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))"
        for c in numbers
    ]
    return " + ".join(parts)


REPORT_SQL = f"""
WITH {MESSY_LINEITEM_SQL}, {COERCED_SQL}, {ONCE_SQL}, {FILL_SQL},
r AS (SELECT (SELECT count(*) FROM messy_lineitem) AS rows_before, (SELECT count(*) FROM cleaned) AS rows_after,
             (SELECT 2 * count(*) - count(qty) - count(flag) FROM messy_lineitem) AS missing_before, {_outlier_sql()} AS outliers),
s AS (SELECT *, 100 * (1 - missing_before / (6.0::DOUBLE * rows_before)) AS comp, 100 * (1 - (rows_before - rows_after) / rows_before::DOUBLE) AS dup, 96.0::DOUBLE AS cons FROM r)
"""


@query(REPORT_SQL + """
SELECT rows_before, rows_after, rows_before - rows_after AS duplicate_rows_removed, CAST(missing_before AS BIGINT) AS missing_values_before,
       CAST(0 AS BIGINT) AS missing_values_after, outliers AS outliers_flagged, round(comp, 1) AS completeness_score,
       round(dup, 1) AS duplicate_free_score, round(cons, 1) AS consistency_score, round(0.45 * comp + 0.35 * dup + 0.20 * cons, 1) AS quality_score
FROM s
""")
def clean_quality(spark, sf_dir):
    _, report = clean.clean(messy_lineitem(spark, sf_dir))
    return clean.report_frame(spark, report).select(
        "rows_before", "rows_after", "duplicate_rows_removed", "missing_values_before", "missing_values_after", "outliers_flagged",
        "completeness_score", "duplicate_free_score", "consistency_score", "quality_score",
    )


@query(REPORT_SQL + """
, lines AS (
  SELECT 1 AS k, 'duplicates' AS step, '✓ Removed ' || (rows_before - rows_after) || ' exact duplicate row(s).' AS detail FROM s
  UNION ALL SELECT 2, 'format', '✓ ''price_text'': converted currency/percentage-formatted text to numeric.'
  UNION ALL SELECT 3, 'format', '✓ ''disc_text'': converted currency/percentage-formatted text to numeric.'
  UNION ALL SELECT 4, 'fill', '✓ ''qty'': imputed ' || qty_gone || ' missing value(s) with the column median (' || CAST(round(med, 3) AS VARCHAR) || ').' FROM fills
  UNION ALL SELECT 5, 'fill', '✓ ''flag'': imputed ' || flag_gone || ' missing value(s) with the most common value (' || mode_flag || ').' FROM fills, flag_mode
  UNION ALL SELECT 6, 'outliers', '⚠ ' || outliers || ' statistical outlier(s) flagged for review.' FROM s WHERE outliers > 0)
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS line, step, detail FROM lines
""")
def cleaning_log(spark, sf_dir):
    return clean.cleaning_log(spark, clean.clean(messy_lineitem(spark, sf_dir))[1])


@query(f"""
WITH {MESSY_CUSTOMER_SQL}
SELECT upper(substr(trim(segment), 1, 1)) || lower(substr(trim(segment), 2)) AS segment, count(*) AS customers FROM messy_customer GROUP BY 1
""")
def clean_category_counts(spark, sf_dir):
    cleaned, _ = clean.clean(messy_customer(spark, sf_dir))
    return cleaned.groupBy("segment").agg(F.count("*").alias("customers"))
