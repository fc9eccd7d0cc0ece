"""Answers to a table of plain-language questions about one analysed table.

Questions are rows: language, intent and the columns they name are plain expressions over the
question text, so any number of questions is one scan. The possible answers (a few per
column) are computed once from the filtered table and joined on (intent, columns).
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.counts import one_row, union_all
from sheetlens.functions.quantiles import exact_quantiles
from sheetlens.functions.values import col, field_type, fixed, grouped_number, numeric, numeric_frame
from sheetlens.operators.filters import apply_filters, has_filters
from sheetlens.operators.profile import TableTypes
from sheetlens.session import small_frame

# Words that reveal the language of a question.
MARATHI_WORDS = ("सरासरी", "एकूण", "किती", "आहे", "काय", "सर्वात", "सर्वाधिक", "दाखवा", "उघडा", "विसंगती", "मला")
HINDI_WORDS = (
    "औसत", "कुल", "कितना", "कितनी", "क्या", "सबसे", "अधिकतम", "न्यूनतम", "दिखाओ", "खोलो", "विसंगति", "kya", "hai", "kitna",
)
DEVANAGARI = "[\\x{0900}-\\x{097F}]"

# Words per intent, in the order the intents are tried.
NAVIGATION_WORDS = (
    ("open_correlation", ("open correlation", "show correlation", "सहसंबंध दिखाओ", "सहसंबंध दाखवा", "सहसंबंध")),
    ("open_explorer", ("open data explorer", "show data explorer", "show data table", "explore data", "डेटा टेबल", "डेटा एक्सप्लोरर")),
    ("open_insights", ("show ai insights", "open insights", "view insights", "key insights", "अंतर्दृष्टि", "अंतर्दृष्टी")),
    ("open_whatif", ("what if", "simulation", "predict", "सिमुलेशन", "सिम्युलेशन")),
    ("clear_filter", ("clear all filters", "clear filter", "reset filter", "फ़िल्टर साफ़", "फिल्टर साफ", "फिल्टर काढा")),
)
CONTEXT_WORDS = (
    "why is this high", "explain this chart", "why is this", "what is this", "tell me about this",
    "यह इतना अधिक क्यों है", "हे जास्त का आहे",
)
AVERAGE_WORDS = ("average", "mean", "avg", "औसत", "माध्य", "सरासरी", "kya hai", "kitna hai")
TOTAL_WORDS = ("total", "sum", "cumulative", "overall", "कुल", "योग", "एकूण", "बेरीज")
SPREAD_WORDS = ("distribution", "spread", "histogram", "वितरण", "विभाजन")
RANK_WORDS = (
    "highest", "top", "rank", "lead", "best", "most", "largest", "patient count", "volume", "count",
    "सबसे ज्यादा", "अधिकतम", "उच्चतम", "सर्वाधिक", "जास्तीत जास्त", "दाखवा", "अव्वल",
)
COUNT_WORDS = ("count", "patient count", "number of", "संख्या")
LINK_WORDS = ("correlat", "relationship", "association", "linked", "connected", "सहसंबंध", "संबंध")
ANOMALY_WORDS = (
    "anomaly", "anomalies", "outlier", "outliers", "unusual", "spike", "irregular", "विसंगति", "असामान्य", "अपवाद", "विसंगती",
)
TREND_WORDS = ("trend", "growth", "over time", "history", "trajectory", "ट्रेंड", "रुझान", "प्रवाह", "कल")

ANSWER_DDL = (
    "intent string, col_a string, col_b string, answer string, supporting_metric string, category string, "
    "confidence int, action string, target string"
)


def any_of(words: tuple[str, ...]) -> str:
    """Pattern that finds any of the words as a substring."""
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(any_of(words))


def detect_language(question: Column, asked: str = "en") -> Column:
    """"en", "hi" or "mr", from script and words; ``asked`` is the caller's choice."""
    lower = F.lower(F.trim(question))
    marathi = has_any(lower, MARATHI_WORDS)
    hindi = has_any(lower, HINDI_WORDS) | question.rlike(DEVANAGARI)
    return F.when(marathi, "mr").when(hindi, asked if asked in ("mr", "hi") else "hi").otherwise(asked)


def _first_named(text: Column, names: list[str], by_prefix: bool = False) -> Column:
    """First column, in table order, whose name (or first four letters) is in the text."""
    tests = []
    for n in names:
        low = n.lower()
        hit = F.contains(text, F.lit(low))
        if by_prefix and len(low) > 3:
            hit = hit | F.contains(text, F.lit(low[:4]))
        tests.append(F.when(hit, n))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def resolve_questions(questions: DataFrame, types: TableTypes, asked: str = "en", names: list[str] | None = None, filled: list[str] | None = None) -> DataFrame:
    """Add language, intent, col_a and col_b to a table with a ``question`` column.

    An optional ``context`` column names the chart the question is about. ``names`` are the
    columns that hold values in the filtered table (default: all numerical ones), ``filled`` the categories that do
    (default: all); a question about a category without values goes on to the later rules.
    """
    numbers = types.numerical if names is None else [n for n in types.numerical if n in names]
    labels = types.categorical
    q = F.lower(F.trim(F.col("question")))
    no_column = F.lit(None).cast("string")
    category = F.coalesce(_first_named(q, labels), F.lit(labels[0]) if labels else no_column)
    ranked = [c for c in labels if filled is None or c in filled]
    context = F.lower(F.col("context")) if "context" in questions.columns else no_column
    in_context = F.coalesce(
        _first_named(context, [c.name for c in types.columns]), F.lit(numbers[0]) if numbers else no_column
    )
    named = _first_named(q, numbers, by_prefix=True)
    average, total, spread = (has_any(q, w) for w in (AVERAGE_WORDS, TOTAL_WORDS, SPREAD_WORDS))
    cases: list[tuple[Column, str]] = [(has_any(q, words), name) for name, words in NAVIGATION_WORDS]
    cases += [
        (has_any(q, CONTEXT_WORDS) & in_context.isin(numbers) if numbers else F.lit(False), "context"),
        (named.isNotNull() & average, "average"),
        (named.isNotNull() & total, "total"),
        (named.isNotNull() & spread, "distribution"),
        (average & F.lit(bool(numbers)), "average_default"),
        (
            has_any(q, RANK_WORDS) & (category.isin(ranked) if ranked else F.lit(False)),
            "ranking",
        ),
        (has_any(q, LINK_WORDS), "correlation"),
        (has_any(q, ANOMALY_WORDS), "anomaly"),
        (has_any(q, TREND_WORDS), "trend"),
    ]
    intent = F.when(cases[0][0], cases[0][1])
    for test, name in cases[1:]:
        intent = intent.when(test, name)
    intent = intent.otherwise("summary")
    counted = has_any(q, COUNT_WORDS) if numbers else F.lit(True)
    number = F.coalesce(_first_named(q, numbers), F.lit(numbers[0]) if numbers else no_column)
    step = questions.withColumn("language", detect_language(F.col("question"), asked)).withColumn("intent", intent)
    i = F.col("intent")
    step = step.withColumn("intent", F.when((i == "ranking") & counted, "frequency").otherwise(i))
    col_a = (
        F.when(i.isin("average", "total", "distribution"), named)
        .when(i == "context", in_context)
        .when(i == "average_default", F.lit(numbers[0]) if numbers else no_column)
        .when(i.isin("ranking", "frequency"), category)
    )
    return step.withColumn("col_a", col_a).withColumn("col_b", F.when(i == "ranking", number))


def _pack(df: DataFrame, intent: str, answer: Column, metric: Column, category: str, confidence: int, action: str, target: Column, a: Column | None = None, b: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(intent).alias("intent"),
        (none if a is None else a).alias("col_a"),
        (none if b is None else b).alias("col_b"),
        answer.alias("answer"),
        metric.alias("supporting_metric"),
        F.lit(category).alias("category"),
        F.lit(confidence).alias("confidence"),
        F.lit(action).alias("action"),
        target.alias("target"),
    )


def metric_table(active: DataFrame, numbers: list[str]) -> DataFrame:
    """One row per numerical column: n, mean, median, min, max, sum, std, q25, q75."""
    nums = numeric_frame(active, numbers)
    aggs = []
    for i, c in enumerate(numbers):
        v = col(c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
        aggs += [F.sum(v).alias(f"sum{i}"), F.stddev_samp(v).alias(f"std{i}")]
    row = one_row(nums, aggs)
    counts = {c: row[f"n{i}"] for i, c in enumerate(numbers)}
    quartiles = exact_quantiles(nums, numbers, [0.25, 0.5, 0.75], counts)
    rows = [
        {"column": c, "q25": quartiles[c][0], "median": quartiles[c][1], "q75": quartiles[c][2]}
        | {k: row[f"{k}{i}"] for k in ("n", "mean", "min", "max", "sum", "std")}
        for i, c in enumerate(numbers)
        if counts[c]
    ]
    return small_frame(
        active.sparkSession,
        rows,
        "column string, n bigint, mean double, median double, min double, max double, sum double, std double, q25 double, q75 double",
    )


def leader_shares(active: DataFrame, category: str, numbers: list[str]) -> DataFrame:
    """Leading group and its share of the total, for every measure, from one group-by."""
    totals = (
        active.select(
            col(category).cast("string").alias("g"), *[numeric(n, field_type(active, n)).alias(f"v{i}") for i, n in enumerate(numbers)]
        )
        .where(F.col("g").isNotNull())
        .groupBy("g")
        .agg(*[F.coalesce(F.sum(f"v{i}"), F.lit(0.0)).alias(f"v{i}") for i in range(len(numbers))])
    )
    # the leader is a constant-size aggregate over the groups, so many groups do no harm
    tops = totals.agg(
        *[a for i in range(len(numbers)) for a in (F.min(F.struct((-F.col(f"v{i}")).alias("neg"), "g")).alias(f"t{i}"), F.sum(f"v{i}").alias(f"s{i}"))]
    )
    pieces = [
        F.struct(
            F.lit(category).alias("category"),
            F.lit(n).alias("measure"),
            F.col(f"t{i}.g").alias("leader"),
            (-F.col(f"t{i}.neg")).alias("value"),
            F.col(f"s{i}").alias("total"),
        )
        for i, n in enumerate(numbers)
    ]
    share = F.when(F.col("total") > 0, 100 * F.col("value") / F.col("total")).otherwise(F.lit(0.0))
    return tops.select(F.inline(F.array(*pieces))).where(F.col("leader").isNotNull()).withColumn("share_pct", share)


def frequent_category(active: DataFrame, category: str) -> DataFrame:
    """Most frequent value and its share of all rows, missing categories included in the rows."""
    groups = active.groupBy(col(category).cast("string").alias("g")).agg(F.count("*").alias("n"))
    named = F.when(F.col("g").isNotNull(), F.struct((-F.col("n")).alias("neg"), "g"))
    return (
        groups.agg(F.min(named).alias("t"), F.sum("n").alias("rows"))
        .where(F.col("t").isNotNull())
        .select(
            F.lit(category).alias("category"),
            F.col("t.g").alias("leader"),
            (-F.col("t.neg")).alias("count"),
            "rows",
            (100 * -F.col("t.neg") / F.col("rows")).alias("share_pct"),
        )
    )


def possible_answers(
    df: DataFrame,
    types: TableTypes,
    strongest_positive: DataFrame | None = None,
    trends: DataFrame | None = None,
    anomalies: DataFrame | None = None,
    active_filters: dict[str, Any] | None = None,
    domain_name: str = "General Structured Dataset",
) -> DataFrame:
    """Every answer a question can get, keyed by (intent, col_a, col_b).

    Metric, ranking and summary answers use the filtered rows; relationship, anomaly and trend
    answers come from the analysis of the whole table. ``anomalies`` is one row (total, row_index,
    column, value).
    """
    spark, txt = df.sparkSession, F.format_string
    active = apply_filters(df, active_filters)
    total = df.count() if has_filters(active_filters) else types.rows
    rows = active.count() if has_filters(active_filters) else types.rows
    # fixed values from here on: the sentences of the answers
    suffix = f" ({rows:,} records after active filters)" if has_filters(active_filters) else ""
    if rows == 0:
        empty = [
            {
                "intent": "empty",
                "answer": "No data matches the selected filters. Adjust your slicers or click below to reset.",
                "supporting_metric": "0 matching rows",
                "category": "filter",
                "confidence": 100,
                "action": "clear_filter",
                "target": "all",
            }
        ]
        return small_frame(spark, empty, ANSWER_DDL)
    plain = [
        ("open_correlation", "Opening Correlation Analysis and feature relationship matrix.", "Correlation Matrix", "navigation", 100, "navigate", "clusters"),
        ("open_explorer", "Navigating to the Data Explorer table.", f"{rows:,} records available", "navigation", 100, "navigate", "explorer"),
        ("open_insights", "Navigating to Prioritized AI Insights.", "Strategic Takeaways", "navigation", 100, "navigate", "insights"),
        ("open_whatif", "Opening What-If Predictive Scenario Simulator.", "Scenario Simulator", "navigation", 100, "navigate", "whatif"),
        ("clear_filter", "Clearing all active slicer filters and restoring the full dataset view.", f"Restoring {total:,} total records", "filter", 100, "clear_filter", "all"),
        (
            "summary",
            f"Analyzing {rows:,} active records across {len(types.columns)} columns for {domain_name}. Data distribution is validated with "
            f"{len(types.numerical)} numerical and {len(types.categorical)} categorical dimensions{suffix}.",
            f"{rows:,} records · {len(types.columns)} columns", "summary", 95, "navigate", "insights",
        ),
        (
            "correlation",
            "No strong linear correlations (|r| >= 0.35) were identified among active numerical columns.",
            "Max |r| < 0.35", "correlation", 92, "navigate", "whatif",
        ),
        (
            "anomaly",
            "No high-severity statistical anomalies were detected in the numerical attributes.",
            "0 critical anomalies", "anomaly", 94, "navigate", "quality",
        ),
        (
            "trend",
            "No temporal date dimension is available in this dataset to compute chronological trends.",
            "0 Date Columns", "trend", 90, None, None,
        ),
    ]
    parts = []
    if strongest_positive is not None and not strongest_positive.isEmpty():
        plain = [p for p in plain if p[0] != "correlation"]
        parts.append(
            _pack(
                strongest_positive, "correlation",
                txt(
                    "The strongest statistical relationship is between '%s' and '%s' with a %s Pearson correlation of r = %s.",
                    F.col("column_a"), F.col("column_b"), F.col("direction"), fixed("correlation"),
                ),
                txt("Pearson r = %s", fixed("correlation")), "correlation", 97, "navigate", F.lit("clusters"),
            )
        )
    if anomalies is not None and not anomalies.where("total > 0").isEmpty():
        plain = [p for p in plain if p[0] != "anomaly"]
        parts.append(
            _pack(
                anomalies, "anomaly",
                txt(
                    "%d data points were identified as statistically unusual via Isolation Forest. Top outlier: Row #%d on '%s' with value %s.",
                    F.col("total"), F.col("row_index"), F.col("column"), grouped_number(F.col("value")),
                ),
                txt("%d anomalies detected", "total"), "anomaly", 96, "navigate", F.lit("explorer"),
            )
        )
    if trends is not None and not trends.isEmpty():
        plain = [p for p in plain if p[0] != "trend"]
        top = trends.orderBy(F.desc(F.abs("total_pct_change")), "col_order").limit(1)
        parts.append(
            _pack(
                top, "trend",
                txt(
                    "Primary measure '%s' exhibits a %s trend with a net change of %+.1f%% across %d periods.",
                    "column", "direction", "total_pct_change", "periods_analyzed",
                ),
                txt("%s: %+.1f%%", "column", "total_pct_change"), "trend", 96, "view_chart", F.col("column"),
            )
        )
    fields = ("intent", "answer", "supporting_metric", "category", "confidence", "action", "target")
    parts.append(small_frame(spark, [dict(zip(fields, p)) for p in plain], ANSWER_DDL))
    if types.numerical:
        m, c, note = metric_table(active, types.numerical), F.col("column"), F.lit(suffix)
        average = txt("Average %s: %s", F.col("column"), fixed("mean"))
        parts += [
            _pack(
                m, "average",
                txt("The average %s is %s (median: %s, range: %s to %s)%s.", c, fixed("mean"), fixed("median"), fixed("min"), fixed("max"), note),
                average, "metric", 98, "view_chart", c, c,
            ),
            _pack(
                m, "average_default",
                txt("The average %s across active records is %s (median: %s)%s.", c, fixed("mean"), fixed("median"), note),
                average, "metric", 96, "view_chart", c, c,
            ),
            _pack(
                m, "total",
                txt("The total cumulative %s is %s across %,d observed records%s.", c, fixed("sum"), F.col("n"), note),
                txt("Total %s: %s", F.col("column"), fixed("sum")), "metric", 98, "view_chart", c, c,
            ),
            _pack(
                m, "distribution",
                txt(
                    "%s has a median of %s with standard deviation of %s (IQR: %s)%s.",
                    c, fixed("median"), fixed(F.coalesce("std", F.lit(0.0))), fixed(F.col("q75") - F.col("q25")), note,
                ),
                txt("Std Dev: %s", fixed(F.coalesce("std", F.lit(0.0)))), "metric", 95, "view_chart", c, c,
            ),
            _pack(
                m, "context",
                txt(
                    "For %s, the active average is %s with peak spikes reaching %s. 75%% of values sit below %s, "
                    "indicating that top outliers are skewing upper distribution thresholds%s.",
                    c, fixed("mean"), fixed("max"), fixed("q75"), note,
                ),
                txt("Mean %s: %s · Max: %s", F.col("column"), fixed("mean"), fixed("max")), "contextual", 96, "view_chart", c, c,
            ),
        ]
    for label in types.categorical:
        if types.numerical:
            top = leader_shares(active, label, types.numerical)
            parts.append(
                _pack(
                    top, "ranking",
                    txt(
                        "'%s' leads %s with %s in total %s, representing %.1f%% of cumulative volume%s.",
                        F.col("leader"), F.col("category"), fixed("value"), F.col("measure"), F.col("share_pct"), F.lit(suffix),
                    ),
                    txt("Top: %s (%s)", F.col("leader"), fixed("value")), "ranking", 98, "apply_filter",
                    txt("%s=%s", "category", "leader"), F.col("category"), F.col("measure"),
                )
            )
        often = frequent_category(active, label)
        parts.append(
            _pack(
                often, "frequency",
                txt(
                    "'%s' has the highest frequency in %s with %,d records (%.1f%% of active rows)%s.",
                    F.col("leader"), F.col("category"), F.col("count"), F.col("share_pct"), F.lit(suffix),
                ),
                txt("%s: %,d records (%.1f%%)", "leader", "count", "share_pct"), "ranking", 98, "apply_filter",
                txt("%s=%s", "category", "leader"), F.col("category"),
            )
        )
    return union_all(parts)


def answer_questions(questions: DataFrame, answers: DataFrame, types: TableTypes, asked: str = "en") -> DataFrame:
    """The answer to every question: a join with the handful of possible answers.

    The answers are collected once (a few rows per column) so that the join side is a local
    table whose size Spark knows; the questions are never shuffled.
    """
    spark = questions.sparkSession
    local = [r.asDict() for r in answers.collect()]
    kept = small_frame(spark, local, ANSWER_DDL)
    if len(local) == 1 and local[0]["intent"] == "empty":
        resolved = questions.withColumn("language", detect_language(F.col("question"), asked))
        fixed = {k: F.lit(v) for k, v in local[0].items()}
        return resolved.select("*", *[v.cast("int" if k == "confidence" else "string").alias(k) for k, v in fixed.items()])
    names = [r["col_a"] for r in local if r["intent"] == "average"]
    filled = [r["col_a"] for r in local if r["intent"] == "frequency"]
    asked_for = resolve_questions(questions, types, asked, names, filled)
    on = [asked_for[k].eqNullSafe(kept[k]) for k in ("intent", "col_a", "col_b")]
    joined = asked_for.join(kept, reduce(lambda a, b: a & b, on), "left")
    return joined.select(asked_for["*"], *[kept[k] for k in ("answer", "supporting_metric", "category", "confidence", "action", "target")])


def suggested_questions(types: TableTypes, anomalies: int, related: bool) -> list[str]:
    """Four starter questions in English."""
    # fixed values: the question forms
    out = []
    if types.categorical and types.numerical:
        out.append(f"Which {types.categorical[0]} has the highest {types.numerical[0]}?")
    if types.numerical:
        out.append(f"What is the average {types.numerical[0]}?")
    if anomalies > 0:
        out.append("Are there any unusual outliers in the data?")
    out.append("Which metrics have the strongest relationship?" if related else "Show me the Data Explorer table")
    return out[:4]


def question_frame(spark, questions: list[str]) -> DataFrame:
    rows = [{"position": i + 1, "question": q} for i, q in enumerate(questions)]
    return small_frame(spark, rows, "position int, question string")
