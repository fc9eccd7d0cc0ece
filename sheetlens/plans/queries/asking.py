"""Queries over insights, the executive summary, and questions with their answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetlens.operators import anomaly, ask, insight, profile
from sheetlens.plans import analysis
from sheetlens.plans.queries.mining import (
    LINE_MONTHS,
    ORDER_MONTHS,
    ORDER_NUMBERS,
    forest_sql,
    kmeans_sql,
    records_sql,
    top_column_sql,
)
from sheetlens.plans.queries.registry import (
    CHANGES_SQL,
    PERIODS_SQL,
    SALES_LINES_SQL,
    SIGNIFICANT_SQL,
    TRENDS_SQL,
    VALUE_COLUMNS,
    bounds_sql,
    outliers_sql,
    pairs_sql,
    query,
    sales_lines,
    table,
    union,
)

# ---- metric answers -------------------------------------------------------------------

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _metric_sql(fields: str) -> str:
    return union([f"SELECT '{c}' AS \"column\", {fields.replace('$', c)} FROM lineitem" for c in NUMBERS])


def _metrics(spark, sf_dir, *fields):
    rows = ask.metric_table(table(spark, sf_dir, "lineitem"), NUMBERS)
    return rows.select("column", *[F.col(f) if f == "n" else F.round(f, 2).alias(f) for f in fields])


@query(_metric_sql("round(avg($), 2) AS mean, round(quantile_cont($, 0.5), 2) AS median, round(min($), 2) AS min, round(max($), 2) AS max"))
def ask_average(spark, sf_dir):
    return _metrics(spark, sf_dir, "mean", "median", "min", "max")


@query(_metric_sql("round(sum($), 2) AS sum, count($) AS n"))
def ask_total(spark, sf_dir):
    return _metrics(spark, sf_dir, "sum", "n")


@query(_metric_sql("round(stddev_samp($), 2) AS std, round(quantile_cont($, 0.5), 2) AS median, round(quantile_cont($, 0.75) - quantile_cont($, 0.25), 2) AS iqr"))
def ask_distribution(spark, sf_dir):
    rows = ask.metric_table(table(spark, sf_dir, "lineitem"), NUMBERS)
    return rows.select("column", F.round("std", 2).alias("std"), F.round("median", 2).alias("median"), F.round(F.col("q75") - F.col("q25"), 2).alias("iqr"))


@query(_metric_sql("round(avg($), 2) AS mean, round(max($), 2) AS max, round(quantile_cont($, 0.75), 2) AS q75"))
def ask_context(spark, sf_dir):
    return _metrics(spark, sf_dir, "mean", "max", "q75")


@query(union([
    f"""SELECT 'o_orderpriority' AS category, '{m}' AS measure, leader, round(value, 2) AS value, round(total, 2) AS total,
        round(CASE WHEN total > 0 THEN 100 * value / total ELSE 0 END, 2) AS share_pct
        FROM (SELECT o_orderpriority AS leader, CAST(sum({m}) AS DOUBLE) AS value, CAST(sum(sum({m})) OVER () AS DOUBLE) AS total, row_number() OVER (ORDER BY sum({m}) DESC, o_orderpriority) AS k
              FROM orders GROUP BY 1) WHERE k = 1"""
    for m in ("o_custkey", "o_totalprice")
]))
def ask_leader_share(spark, sf_dir):
    shares = ask.leader_shares(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_custkey", "o_totalprice"])
    return shares.select("category", "measure", "leader", *[F.round(c, 2).alias(c) for c in ("value", "total", "share_pct")])


@query("""
SELECT 'o_orderstatus' AS category, o_orderstatus AS leader, count(*) AS count, CAST(sum(count(*)) OVER () AS BIGINT) AS rows, round(100 * count(*) / sum(count(*)) OVER (), 2) AS share_pct
FROM orders GROUP BY o_orderstatus ORDER BY count DESC, o_orderstatus LIMIT 1
""")
def ask_frequent_category(spark, sf_dir):
    often = ask.frequent_category(table(spark, sf_dir, "orders"), "o_orderstatus")
    return often.withColumn("share_pct", F.round("share_pct", 2))


# ---- facts, insights, summary ------------------------------------------------------------

FACTS_SQL = f"""
WITH {SALES_LINES_SQL}, {bounds_sql('sales_lines', VALUE_COLUMNS)}, {outliers_sql('sales_lines', VALUE_COLUMNS)},
{records_sql('sales_lines', VALUE_COLUMNS)}, {LINE_MONTHS}, {CHANGES_SQL}, {PERIODS_SQL}, {TRENDS_SQL},
{pairs_sql('sales_lines', VALUE_COLUMNS)}, {SIGNIFICANT_SQL}, {forest_sql("SELECT * FROM sales_lines", VALUE_COLUMNS)},
{kmeans_sql("SELECT * FROM sales_lines", VALUE_COLUMNS)},
leaders AS (SELECT l_returnflag AS top_category, round(sum(l_quantity), 2) AS value FROM sales_lines GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 1),
unordered AS (
  SELECT 0 AS g, col_order * 2.0 AS p, 'anomaly_univariate' AS kind, "column" AS column_a, NULL::VARCHAR AS column_b, NULL::VARCHAR AS label,
         NULL::VARCHAR AS direction, NULL::DOUBLE AS value, iqr_outliers AS count FROM outliers WHERE zscore_outliers > 0 OR iqr_outliers > 0
  UNION ALL SELECT 0, -1.0, 'anomaly_multivariate', NULL, NULL, NULL, NULL, round(100.0 * count(*) / (SELECT n FROM forest_sizes), 2), count(*) FROM forest_flags HAVING count(*) > 0
  UNION ALL SELECT 0, col_order * 2.0 + 1, 'anomaly_time', "column", NULL, period, direction, pct_change, NULL FROM periods
  UNION ALL SELECT 1, k, 'trend', "column", NULL, NULL, direction, total_pct_change, periods_analyzed
            FROM (SELECT *, row_number() OVER (ORDER BY abs(total_pct_change) DESC, col_order) AS k FROM trends) WHERE k <= 3
  UNION ALL SELECT 2, k, 'correlation', column_a, column_b, strength, direction, correlation, NULL
            FROM (SELECT *, row_number() OVER (ORDER BY abs(correlation) DESC, oa, ob) AS k FROM significant) WHERE k <= 3
  UNION ALL SELECT 3, 0, 'ranking', 'l_returnflag', 'l_quantity', top_category, NULL, value, NULL FROM leaders
  UNION ALL SELECT 4, 0, 'cluster', NULL, NULL, NULL, NULL, silhouette_score, n_clusters FROM segment_head),
facts AS (SELECT * EXCLUDE (g, p), CAST(row_number() OVER (ORDER BY g, p) AS INTEGER) AS fact_order FROM unordered)
"""

CARDS_SQL = FACTS_SQL + """
, cards AS (
  SELECT fact_order, kind,
         CASE kind WHEN 'correlation' THEN 'correlation' WHEN 'anomaly_time' THEN 'anomaly' WHEN 'anomaly_multivariate' THEN 'anomaly' WHEN 'ranking' THEN 'ranking' WHEN 'cluster' THEN 'segmentation' ELSE 'trend' END AS category,
         CASE kind WHEN 'correlation' THEN CASE WHEN abs(value) >= 0.8 THEN 'critical' WHEN abs(value) >= 0.55 THEN 'important' ELSE 'informational' END
                   WHEN 'trend' THEN CASE WHEN abs(value) >= 25 THEN 'critical' WHEN abs(value) >= 10 THEN 'important' ELSE 'informational' END
                   WHEN 'anomaly_time' THEN CASE WHEN abs(value) >= 30 THEN 'critical' ELSE 'important' END
                   WHEN 'ranking' THEN 'important' WHEN 'anomaly_multivariate' THEN 'critical' ELSE 'informational' END AS priority,
         CASE kind WHEN 'correlation' THEN 'Strong Link: ' || column_a || ' & ' || column_b
                   WHEN 'trend' THEN column_a || ' Shows ' || CASE direction WHEN 'increasing' THEN 'Increasing' WHEN 'decreasing' THEN 'Decreasing' ELSE 'Stable/Fluctuating' END
                        || ' Momentum (' || CASE WHEN value >= 0 THEN '+' ELSE '-' END || format('{:.1f}', abs(value)) || '%)'
                   WHEN 'anomaly_multivariate' THEN 'Unusual Records Detected (' || count || ' rows)'
                   WHEN 'anomaly_time' THEN 'Sharp Volatility Spike in ' || column_a
                   WHEN 'ranking' THEN 'Top Performer: ''' || label || ''' Leads ' || column_a
                   WHEN 'cluster' THEN count || ' Distinct Operational Segments Identified'
                   ELSE 'Baseline Performance Distribution' END AS title,
         CASE kind WHEN 'correlation' THEN 'Pearson r = ' || format('{:.2f}', value) || ' (' || direction || ')'
                   WHEN 'trend' THEN CASE WHEN value >= 0 THEN '+' ELSE '-' END || format('{:.1f}', abs(value)) || '% Net Change'
                   WHEN 'anomaly_time' THEN CASE WHEN value >= 0 THEN '+' ELSE '-' END || format('{:.1f}', abs(value)) || '% Period Spike (' || label || ')'
                   WHEN 'anomaly_multivariate' THEN count || ' Unusual Records (' || value || '% of rows)'
                   WHEN 'ranking' THEN '#1 Rank · ' || format('{:,.2f}', value) || ' ' || column_b
                   WHEN 'cluster' THEN count || ' Segments Identified'
                   ELSE 'Verified Clean' END AS supporting_metric,
         CASE kind WHEN 'trend' THEN column_a WHEN 'anomaly_time' THEN column_a WHEN 'anomaly_univariate' THEN 'Overview' WHEN 'anomaly_multivariate' THEN 'All numerical features' WHEN 'cluster' THEN 'Normalized numerical space' END AS single_source
  FROM facts),
kept AS (SELECT *, CASE priority WHEN 'critical' THEN 0 WHEN 'important' THEN 1 ELSE 2 END AS pr FROM (
  SELECT *, row_number() OVER (PARTITION BY single_source IS NULL, coalesce(single_source, '#' || fact_order) ORDER BY fact_order) AS k FROM cards) WHERE k = 1),
top_cards AS (SELECT * FROM kept ORDER BY pr, fact_order LIMIT 10)
"""


def _analysis(spark, sf_dir):
    df = sales_lines(spark, sf_dir)
    return df, analysis.analyse(df)


@query(FACTS_SQL + " SELECT * FROM facts")
def facts_union(spark, sf_dir):
    return _analysis(spark, sf_dir)[1].facts()


CARD_COLUMNS = ["fact_order", "kind", "category", "priority", "title", "supporting_metric"]


@query(CARDS_SQL + f" SELECT {', '.join(CARD_COLUMNS)} FROM top_cards")
def insights_priority(spark, sf_dir):
    cards = insight.insight_cards(_analysis(spark, sf_dir)[1].facts())
    return insight.prioritise(cards).select(*CARD_COLUMNS)


@query(CARDS_SQL + f" SELECT {', '.join(CARD_COLUMNS)} FROM (SELECT * FROM top_cards ORDER BY pr, fact_order LIMIT 5)")
def insights_strip(spark, sf_dir):
    cards = insight.insight_cards(_analysis(spark, sf_dir)[1].facts())
    return insight.strip_cards(insight.prioritise(cards)).select(*CARD_COLUMNS)


@query(CARDS_SQL + f" SELECT {', '.join(CARD_COLUMNS)} FROM top_cards WHERE priority = 'critical' AND (contains(lower(title), 'revenue') OR contains(lower(supporting_metric), 'revenue'))")
def insights_filtered(spark, sf_dir):
    cards = insight.prioritise(insight.insight_cards(_analysis(spark, sf_dir)[1].facts()))
    return insight.filter_insights(cards, "critical", "Revenue").select(*CARD_COLUMNS)


_SIGNED = "CASE WHEN value >= 0 THEN '+' ELSE '-' END || format('{:.1f}', abs(value)) || '%'"


@query(CARDS_SQL + f"""
SELECT fact_order, kind,
  CASE kind WHEN 'correlation' THEN column_a || ' and ' || column_b || ' exhibit a ' || label || ' ' || direction || ' correlation of r = ' || format('{{:.2f}}', value) || '.'
    WHEN 'trend' THEN column_a || ' demonstrated a net ' || {_SIGNED} || ' ' || direction || ' trajectory across ' || count || ' observed chronological periods.'
    WHEN 'anomaly_multivariate' THEN count || ' records (' || value || '% of the dataset) contain unusual values deviating from expected normal patterns.'
    WHEN 'anomaly_time' THEN 'A ' || format('{{:.1f}}', abs(value)) || '% ' || direction || ' in ' || column_a || ' occurred during ' || label || ', significantly exceeding historical baseline volatility.'
    WHEN 'ranking' THEN '''' || label || ''' is the #1 performing ' || column_a || ', generating ' || format('{{:,.2f}}', value) || ' in cumulative ' || column_b || '.'
    WHEN 'cluster' THEN 'Data naturally divides into ' || count || ' distinct operational cohorts based on shared behavioral characteristics.'
    ELSE 'Data distribution exhibits normal baseline metrics across primary features.' END AS finding,
  CASE WHEN kind IN ('correlation', 'ranking') THEN column_a || ', ' || column_b ELSE single_source END AS sources,
  CASE kind WHEN 'correlation' THEN 'Pearson Correlation Coefficient' WHEN 'trend' THEN 'OLS Linear Regression on Resampled Chronological Series'
    WHEN 'anomaly_multivariate' THEN 'Isolation Forest (Ensemble Tree Anomaly Scoring)' WHEN 'anomaly_time' THEN 'Period-over-period delta threshold scan'
    WHEN 'ranking' THEN 'Group sum on ' || column_a || ' aggregated by ' || column_b WHEN 'cluster' THEN 'K-Means (k=' || count || ') with Silhouette validation' ELSE 'Distribution Profiling' END AS calculation,
  CASE kind WHEN 'correlation' THEN 'r = ' || format('{{:.2f}}', value) WHEN 'trend' THEN {_SIGNED} || ' over ' || count || ' periods'
    WHEN 'anomaly_multivariate' THEN count || ' records (' || value || '%)' WHEN 'anomaly_time' THEN {_SIGNED}
    WHEN 'ranking' THEN format('{{:,.2f}}', value) WHEN 'cluster' THEN 'Score ' || format('{{:.2f}}', value) ELSE 'Baseline' END AS metric_value,
  CASE WHEN kind = 'cluster' THEN 'Medium Impact' WHEN priority = 'critical' THEN 'High Impact' WHEN priority = 'important' THEN 'Medium Impact' ELSE 'Low Impact' END AS importance
FROM cards JOIN facts USING (fact_order, kind)
""")
def insight_details(spark, sf_dir):
    """Finding, provenance and importance of every card."""
    cards = insight.insight_cards(_analysis(spark, sf_dir)[1].facts())
    found = cards.select("fact_order", "kind", "finding", "provenance.*", "importance").drop("reason")
    return found.withColumn("sources", F.array_join("source_columns", ", ")).drop("source_columns")


# rows that the forest flags or a record of the report names: as many records as the forest's leave room for
ANOMALIES_SQL = f"""anomalies AS (
  SELECT count(DISTINCT row_id) AS total
  FROM (SELECT row_id FROM forest_flags UNION ALL SELECT row_id FROM records WHERE record <= {anomaly.ALL_RECORDS} - least({anomaly.FOREST_RECORDS}, (SELECT count(*) FROM forest_flags))))"""


@query(CARDS_SQL + ", " + ANOMALIES_SQL + """
, n AS (SELECT count(*) AS n FROM sales_lines),
p AS (SELECT * FROM significant ORDER BY abs(correlation) DESC, oa, ob LIMIT 1),
t AS (SELECT * FROM trends ORDER BY abs(total_pct_change) DESC, col_order LIMIT 1)
SELECT 'Across ' || format('{:,}', n.n) || ' verified records in Sales Analytics, core volume trends and segment distributions indicate consistent operational performance.'
       || chr(10) || chr(10) || 'Key findings indicate that the leading segment is ''' || top_category || ''' for l_quantity ('
       || regexp_replace(format('{:,.2f}', leaders.value), '0$', '') || '); and a ' || strength || ' ' || p.direction || ' correlation connects ' || column_a || ' and ' || column_b
       || ' (r = ' || format('{:.2f}', correlation) || '); and ' || t."column" || ' demonstrated an overall ' || t.direction || ' trend ('
       || CASE WHEN total_pct_change >= 0 THEN '+' ELSE '-' END || format('{:.1f}', abs(total_pct_change)) || '% across ' || periods_analyzed || ' periods).'
       || chr(10) || chr(10) || 'Dataset health is validated at 96.0%. '
       || CASE WHEN total > 0 THEN total || ' records contain unusual values flagged for operational review.'
               ELSE 'No critical statistical anomalies or extreme distribution outliers were detected.' END AS summary,
       'Top Performance: ''' || top_category || ''' is the strongest segment in l_quantity with a total of ' || regexp_replace(format('{:,.2f}', leaders.value), '0$', '') || '.' AS takeaway_1,
       'Temporal Trend: ' || t."column" || ' shows a ' || t.direction || ' trajectory (' || CASE WHEN total_pct_change >= 0 THEN '+' ELSE '-' END || format('{:.1f}', abs(total_pct_change)) || '%).' AS takeaway_2,
       CASE WHEN total > 0 THEN 'Anomalies Flagged: ' || total || ' unusual observation(s) identified for manual audit.'
            ELSE 'Anomaly Check: Zero extreme statistical outliers detected in the main measures.' END AS takeaway_3,
       'Segmentation: Identified ' || n_clusters || ' distinct behavioral clusters using K-Means (silhouette score ' || format('{:.2f}', silhouette_score) || ').' AS takeaway_4,
       'Actionable Recommendation: Focus operational optimization on high-performing clusters and investigate flagged outliers prior to resource allocation.' AS takeaway_5
FROM n, anomalies, p, t, leaders, segment_head
""")
def exec_summary(spark, sf_dir):
    df, a = _analysis(spark, sf_dir)
    out = insight.executive_summary(analysis.headline(df, a, "Sales Analytics", 96.0))
    return out.select("summary", *[F.element_at("key_takeaways", i).alias(f"takeaway_{i}") for i in range(1, 6)])


# ---- questions -----------------------------------------------------------------------------

# One question per order, worded by its status and priority, beside every conversation turn as it is.
QUESTION_FORMS = {
    ("F", "1-URGENT"): "What is the average o_totalprice?",
    ("F", "2-HIGH"): "Total of o_custkey please",
    ("F", "3-MEDIUM"): "Show the distribution of o_totalprice",
    ("F", "4-NOT SPECIFIED"): "Which o_orderpriority has the highest o_totalprice?",
    ("F", "5-LOW"): "Which o_orderstatus has the largest record count?",
    ("O", "1-URGENT"): "Are there any unusual outliers in the data?",
    ("O", "2-HIGH"): "Which metrics have the strongest relationship?",
    ("O", "3-MEDIUM"): "How is the growth over time?",
    ("O", "4-NOT SPECIFIED"): "Open data explorer",
    ("O", "5-LOW"): "Why is this high?",
    ("P", "1-URGENT"): "o_totalprice का औसत क्या है",
    ("P", "2-HIGH"): "o_totalprice ची सरासरी किती आहे",
    ("P", "3-MEDIUM"): "Run a what if simulation",
    ("P", "4-NOT SPECIFIED"): "Clear filter now",
    ("P", "5-LOW"): "Give me the average",
}
_FORMS_SQL = "CASE " + " ".join(
    f"WHEN o_orderstatus = '{s}' AND o_orderpriority = '{p}' THEN '{text}'" for (s, p), text in QUESTION_FORMS.items()
) + " ELSE 'Summary please' END"
QUESTIONS_SQL = f"""
questions AS (
  SELECT 'order' AS origin, o_orderkey AS k, CAST(0 AS BIGINT) AS turn, {_FORMS_SQL} AS question FROM orders
  UNION ALL SELECT 'conversation', conv_id, turn, text FROM conversations)
"""


def questions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.lit("order").alias("origin"), F.col("o_orderkey").alias("k"), F.lit(0).cast("bigint").alias("turn"), F.expr(_FORMS_SQL).alias("question")
    )
    talks = table(spark, sf_dir, "conversations").select(
        F.lit("conversation").alias("origin"), F.col("conv_id").alias("k"), "turn", F.col("text").alias("question")
    )
    return orders.unionByName(talks)


def _any_sql(words) -> str:
    return f"regexp_matches(q, '{ask.any_of(words)}')"


_NUMS, _CATS = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]
_NAMED = "CASE " + " ".join(f"WHEN contains(q, '{c}') OR contains(q, '{c[:4]}') THEN '{c}'" for c in _NUMS) + " END"
_INTENTS = [(_any_sql(words), name) for name, words in ask.NAVIGATION_WORDS] + [
    (_any_sql(ask.CONTEXT_WORDS), "context"),
    (f"named IS NOT NULL AND {_any_sql(ask.AVERAGE_WORDS)}", "average"),
    (f"named IS NOT NULL AND {_any_sql(ask.TOTAL_WORDS)}", "total"),
    (f"named IS NOT NULL AND {_any_sql(ask.SPREAD_WORDS)}", "distribution"),
    (_any_sql(ask.AVERAGE_WORDS), "average_default"),
    (f"{_any_sql(ask.RANK_WORDS)} AND {_any_sql(ask.COUNT_WORDS)}", "frequency"),
    (_any_sql(ask.RANK_WORDS), "ranking"),
    (_any_sql(ask.LINK_WORDS), "correlation"),
    (_any_sql(ask.ANOMALY_WORDS), "anomaly"),
    (_any_sql(ask.TREND_WORDS), "trend"),
]
RESOLVED_SQL = f"""
WITH {QUESTIONS_SQL},
named AS (SELECT *, lower(trim(question)) AS q FROM questions), named2 AS (SELECT *, {_NAMED} AS named FROM named),
intents AS (SELECT *, CASE {' '.join(f"WHEN {t} THEN '{n}'" for t, n in _INTENTS)} ELSE 'summary' END AS intent,
  CASE WHEN {_any_sql(ask.MARATHI_WORDS)} THEN 'mr' WHEN {_any_sql(ask.HINDI_WORDS)} OR regexp_matches(question, '{ask.DEVANAGARI}') THEN 'hi' ELSE 'en' END AS language
  FROM named2),
resolved AS (SELECT origin, k, turn, question, language, intent,
  CASE WHEN intent IN ('average', 'total', 'distribution') THEN named WHEN intent IN ('context', 'average_default') THEN 'o_orderkey'
       WHEN intent IN ('ranking', 'frequency') THEN CASE WHEN contains(q, 'o_orderstatus') THEN 'o_orderstatus' WHEN contains(q, 'o_orderpriority') THEN 'o_orderpriority' ELSE 'o_orderstatus' END END AS col_a,
  CASE WHEN intent = 'ranking' THEN CASE {' '.join(f"WHEN contains(q, '{c}') THEN '{c}'" for c in _NUMS)} ELSE 'o_orderkey' END END AS col_b
  FROM intents)
"""


def _resolved(spark, sf_dir):
    types = profile.infer_types(table(spark, sf_dir, "orders"))
    return ask.resolve_questions(questions(spark, sf_dir), types)


@query(RESOLVED_SQL + " SELECT origin, k, turn, intent FROM resolved")
def question_intent(spark, sf_dir):
    return _resolved(spark, sf_dir).select("origin", "k", "turn", "intent")


@query(RESOLVED_SQL + " SELECT origin, k, turn, language FROM resolved")
def question_language(spark, sf_dir):
    return _resolved(spark, sf_dir).select("origin", "k", "turn", "language")


@query(RESOLVED_SQL + " SELECT origin, k, turn, intent, col_a, col_b FROM resolved")
def question_columns(spark, sf_dir):
    return _resolved(spark, sf_dir).select("origin", "k", "turn", "intent", "col_a", "col_b")


@query("""
SELECT CAST(1 AS INTEGER) AS position, 'Which o_orderstatus has the highest o_orderkey?' AS question
UNION ALL SELECT 2, 'What is the average o_orderkey?'
UNION ALL SELECT 3, 'Are there any unusual outliers in the data?'
UNION ALL SELECT 4, 'Show me the Data Explorer table'
""")
def suggested_questions(spark, sf_dir):
    df = table(spark, sf_dir, "orders", ids=True)
    a = analysis.analyse(df, segments=False)
    asked = ask.suggested_questions(a.types, a.total_anomalies, not a.significant.isEmpty())
    return ask.question_frame(spark, asked)


def _answer_sql() -> str:
    stats = union([
        f"""SELECT '{c}' AS c, format('{{:,.2f}}', avg({c})) AS mean, format('{{:,.2f}}', quantile_cont(CAST({c} AS DOUBLE), 0.5)) AS med,
            format('{{:,.2f}}', CAST(min({c}) AS DOUBLE)) AS lo, format('{{:,.2f}}', CAST(max({c}) AS DOUBLE)) AS hi, format('{{:,.2f}}', CAST(sum({c}) AS DOUBLE)) AS total,
            format('{{:,}}', count({c})) AS n, format('{{:,.2f}}', stddev_samp({c})) AS std, format('{{:,.2f}}', quantile_cont(CAST({c} AS DOUBLE), 0.75)) AS q75,
            format('{{:,.2f}}', quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS iqr FROM active"""
        for c in _NUMS
    ])
    leaders = union([
        f"""SELECT '{g}' AS g, '{m}' AS m, leader, format('{{:,.2f}}', v) AS v, format('{{:.1f}}', 100 * v / total) AS share FROM (
            SELECT {g} AS leader, CAST(sum({m}) AS DOUBLE) AS v, CAST(sum(sum({m})) OVER () AS DOUBLE) AS total, row_number() OVER (ORDER BY sum({m}) DESC, {g}) AS k FROM active GROUP BY 1) WHERE k = 1"""
        for g in _CATS for m in _NUMS
    ])
    often = union([
        f"""SELECT '{g}' AS g, leader, format('{{:,}}', v) AS v, format('{{:.1f}}', 100 * v / total) AS share FROM (
            SELECT {g} AS leader, count(*) AS v, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, {g}) AS k FROM active GROUP BY 1) WHERE k = 1"""
        for g in _CATS
    ])
    return f"""
, active AS (SELECT * FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 400000),
st AS ({stats}), ld AS ({leaders}), fr AS ({often}),
n AS (SELECT format('{{:,}}', (SELECT count(*) FROM active)) AS rows, format('{{:,}}', (SELECT count(*) FROM orders)) AS total,
      ' (' || format('{{:,}}', (SELECT count(*) FROM active)) || ' records after active filters)' AS suffix),
tr AS (SELECT * FROM trends ORDER BY abs(total_pct_change) DESC, col_order LIMIT 1),
possible AS (
  SELECT 'average' AS intent, c AS a, NULL AS b, 'The average ' || c || ' is ' || mean || ' (median: ' || med || ', range: ' || lo || ' to ' || hi || ')' || suffix || '.' AS answer, 'Average ' || c || ': ' || mean AS metric, 98 AS confidence FROM st, n
  UNION ALL SELECT 'average_default', c, NULL, 'The average ' || c || ' across active records is ' || mean || ' (median: ' || med || ')' || suffix || '.', 'Average ' || c || ': ' || mean, 96 FROM st, n
  UNION ALL SELECT 'total', c, NULL, 'The total cumulative ' || c || ' is ' || st.total || ' across ' || st.n || ' observed records' || suffix || '.', 'Total ' || c || ': ' || st.total, 98 FROM st, n
  UNION ALL SELECT 'distribution', c, NULL, c || ' has a median of ' || med || ' with standard deviation of ' || std || ' (IQR: ' || iqr || ')' || suffix || '.', 'Std Dev: ' || std, 95 FROM st, n
  UNION ALL SELECT 'context', c, NULL, 'For ' || c || ', the active average is ' || mean || ' with peak spikes reaching ' || hi || '. 75% of values sit below ' || q75 || ', indicating that top outliers are skewing upper distribution thresholds' || suffix || '.', 'Mean ' || c || ': ' || mean || ' · Max: ' || hi, 96 FROM st, n
  UNION ALL SELECT 'ranking', g, m, '''' || leader || ''' leads ' || g || ' with ' || v || ' in total ' || m || ', representing ' || share || '% of cumulative volume' || suffix || '.', 'Top: ' || leader || ' (' || v || ')', 98 FROM ld, n
  UNION ALL SELECT 'frequency', g, NULL, '''' || leader || ''' has the highest frequency in ' || g || ' with ' || v || ' records (' || share || '% of active rows)' || suffix || '.', leader || ': ' || v || ' records (' || share || '%)', 98 FROM fr, n
  UNION ALL SELECT 'open_correlation', NULL, NULL, 'Opening Correlation Analysis and feature relationship matrix.', 'Correlation Matrix', 100
  UNION ALL SELECT 'open_explorer', NULL, NULL, 'Navigating to the Data Explorer table.', rows || ' records available', 100 FROM n
  UNION ALL SELECT 'open_insights', NULL, NULL, 'Navigating to Prioritized AI Insights.', 'Strategic Takeaways', 100
  UNION ALL SELECT 'open_whatif', NULL, NULL, 'Opening What-If Predictive Scenario Simulator.', 'Scenario Simulator', 100
  UNION ALL SELECT 'clear_filter', NULL, NULL, 'Clearing all active slicer filters and restoring the full dataset view.', 'Restoring ' || total || ' total records', 100 FROM n
  UNION ALL SELECT 'summary', NULL, NULL, 'Analyzing ' || rows || ' active records across 6 columns for Sales Analytics. Data distribution is validated with 3 numerical and 2 categorical dimensions' || suffix || '.', rows || ' records · 6 columns', 95 FROM n
  UNION ALL SELECT 'correlation', NULL, NULL, 'No strong linear correlations (|r| >= 0.35) were identified among active numerical columns.', 'Max |r| < 0.35', 92
  UNION ALL SELECT 'anomaly', NULL, NULL, anomalies.total || ' data points were identified as statistically unusual via Isolation Forest. Top outlier: Row #' || (row_id + 1) || ' on ''' || top_column
       || ''' with value ' || regexp_replace(format('{{:,.2f}}', top_value), '0$', '') || '.', anomalies.total || ' anomalies detected', 96 FROM anomalies, first_flagged
  UNION ALL SELECT 'trend', NULL, NULL, 'Primary measure ''' || "column" || ''' exhibits a ' || direction || ' trend with a net change of ' || CASE WHEN total_pct_change >= 0 THEN '+' ELSE '-' END || format('{{:.1f}}', abs(total_pct_change)) || '% across ' || periods_analyzed || ' periods.',
       "column" || ': ' || CASE WHEN total_pct_change >= 0 THEN '+' ELSE '-' END || format('{{:.1f}}', abs(total_pct_change)) || '%', 96 FROM tr)
SELECT origin, k, turn, r.intent, answer, metric AS supporting_metric, CAST(confidence AS INTEGER) AS confidence
FROM resolved r LEFT JOIN possible p ON p.intent = r.intent AND p.a IS NOT DISTINCT FROM r.col_a AND p.b IS NOT DISTINCT FROM r.col_b
"""


ORDER_ANOMALIES_SQL = f"""
order_rows AS (SELECT *, row_number() OVER () - 1 AS row_id FROM orders), {bounds_sql("order_rows", ORDER_NUMBERS)}, {records_sql("order_rows", ORDER_NUMBERS)},
{forest_sql("SELECT * FROM order_rows", ORDER_NUMBERS)}, {ANOMALIES_SQL},
first_flagged AS (SELECT row_id, {top_column_sql(ORDER_NUMBERS)} FROM forest_flags ORDER BY row_id LIMIT 1)
"""


@query(RESOLVED_SQL + ", " + ORDER_MONTHS + ", " + TRENDS_SQL + ", " + ORDER_ANOMALIES_SQL + _answer_sql())
def answer_questions(spark, sf_dir):
    df = table(spark, sf_dir, "orders", ids=True)
    a = analysis.analyse(df, segments=False)
    answers = analysis.answers(df, a, {"o_totalprice": {"min": 100000, "max": 400000}}, "Sales Analytics")
    out = ask.answer_questions(questions(spark, sf_dir), answers, a.types)
    return out.select("origin", "k", "turn", "intent", "answer", "supporting_metric", "confidence")


@query(f"WITH {QUESTIONS_SQL} SELECT origin, k, turn, 'No data matches the selected filters. Adjust your slicers or click below to reset.' AS answer, '0 matching rows' AS supporting_metric FROM questions")
def answer_empty_filter(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    types = profile.infer_types(df)
    answers = ask.possible_answers(df, types, active_filters={"o_totalprice": {"min": 1e12}})
    return ask.answer_questions(questions(spark, sf_dir), answers, types).select("origin", "k", "turn", "answer", "supporting_metric")
