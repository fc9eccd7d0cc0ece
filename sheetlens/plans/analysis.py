"""Full analysis of one table, and the dashboard built from its results.

The table is read by a fixed number of jobs; every result has a few rows per column and
is kept as a local table, so that insights, charts and answers never recompute it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.operators import anomaly, charts, iforest, insight, kpi, recommend, segment, series, stats
from sheetlens.operators.ask import possible_answers, question_frame, suggested_questions
from sheetlens.operators.domain import classify_domain, domain_scores
from sheetlens.operators.profile import TableTypes, column_types, infer_types
from sheetlens.session import run_together, small_frame
from sheetlens.sources.row_ids import ROW_ID, with_row_id


def settle(df: DataFrame) -> DataFrame:
    """A result table of a few rows per column, computed now and kept as a local table."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@dataclass
class Analysis:
    types: TableTypes
    pairs: DataFrame | None = None
    significant: DataFrame | None = None
    outliers: DataFrame | None = None
    periods: DataFrame | None = None
    trends: DataFrame | None = None
    records: DataFrame | None = None
    forest: DataFrame | None = None
    segments: DataFrame | None = None
    segment_head: DataFrame | None = None
    segment_reason: str | None = None
    leaders: DataFrame | None = None
    total_anomalies: int = 0

    def facts(self) -> DataFrame:
        return insight.assemble_facts(
            self.outliers, self.periods, self.trends, self.significant, self.leaders, self.forest, self.segment_head
        )

    def has_facts(self) -> bool:
        return any(x is not None for x in (self.outliers, self.periods, self.trends, self.significant, self.leaders))


def analyse(df: DataFrame, types: TableTypes | None = None, forest: bool = True, segments: bool = True) -> Analysis:
    """Correlations, anomalies, trends, segments and leaders of a table with row ids."""
    df = with_row_id(df)
    types = types or infer_types(df)
    out, nums = Analysis(types), types.numerical
    tasks = {}
    # the long ones first
    if segments:
        tasks["segments"] = lambda: segment.segments(df, nums)
    if nums and forest:
        tasks["forest"] = lambda: iforest.isolation_forest(df, nums)
    if nums:
        tasks["outliers"] = lambda: _univariate(df, nums)
    if nums and types.date_column:
        tasks["months"] = lambda: _monthly(df, types)
    if len(nums) >= 2:
        tasks["pairs"] = lambda: settle(stats.correlations(df, nums))
    if nums and types.categorical:
        tasks["leaders"] = lambda: settle(charts.leader(df, types.categorical[0], nums[0]))
    done = run_together(tasks)

    out.pairs, out.leaders = done.get("pairs"), done.get("leaders")
    if out.pairs is not None:
        out.significant = settle(stats.significant_pairs(out.pairs))
    if "months" in done:
        out.periods, out.trends = done["months"]
    if nums:
        out.outliers, records = done["outliers"]
        scored, flagged = done.get("forest"), None
        first = None
        if scored is not None:
            out.forest = settle(iforest.summary(scored))
            flagged = scored.where("is_outlier")
            first = anomaly.flagged_records(flagged.orderBy(ROW_ID).limit(anomaly.FOREST_RECORDS))
        merged = settle(anomaly.merge_records(first, records))
        out.records = settle(anomaly.with_row_index(merged, df))
        out.total_anomalies = anomaly.total_anomalies(flagged, out.records).first()[0]
    if segments:
        profile, score, out.segment_reason = done["segments"]
        if profile is not None:
            out.segments = settle(profile)
            head = out.segments.agg(F.count("*").alias("n_clusters"))
            out.segment_head = settle(head.withColumn("silhouette_score", F.round(F.lit(score), 3)))
    return out


def _univariate(df: DataFrame, nums: list[str]) -> tuple[DataFrame, DataFrame]:
    """Outlier counts and the first outliers per column."""
    bounds = anomaly.outlier_bounds(df, nums)
    return settle(anomaly.univariate_outliers(df, bounds)), settle(anomaly.iqr_records(df, bounds))


def _monthly(df: DataFrame, types: TableTypes) -> tuple[DataFrame, DataFrame]:
    """Period changes and trends, both from one table of month sums (a row per month and column)."""
    monthly = settle(series.monthly_sums(df, types.time(df), types.numerical))
    counts = {c: types.get(c).present for c in types.numerical}
    return settle(series.period_anomalies(monthly, counts)), settle(series.trends(monthly))


HEADLINE_DDL = (
    "domain_name string, row_count bigint, column_count int, quality_score double, total_anomalies bigint, "
    "leader struct<top_category:string,metric_label:string,value:double>, "
    "pair struct<column_a:string,column_b:string,correlation:double,strength:string,direction:string>, "
    "trend struct<column:string,direction:string,total_pct_change:double,periods_analyzed:bigint>, "
    "n_clusters bigint, silhouette_score double"
)


def headline(df: DataFrame, a: Analysis, domain_name: str, quality_score: float) -> DataFrame:
    """The one row of facts the executive summary is written from."""

    def first(rows: DataFrame | None, order: list, fields: tuple[str, ...]) -> dict | None:
        row = None if rows is None else rows.orderBy(*order).select(*fields).first()
        return None if row is None else row.asDict()

    leader_fields = ("top_category", "metric_label", "value")
    pair_fields = ("column_a", "column_b", "correlation", "strength", "direction")
    trend_fields = ("column", "direction", "total_pct_change", "periods_analyzed")
    row = {
        "domain_name": domain_name,
        "row_count": a.types.rows,
        "column_count": len(a.types.columns),
        "quality_score": float(quality_score),
        "total_anomalies": a.total_anomalies,
        "leader": first(a.leaders, ["top_category"], leader_fields),
        "pair": first(a.significant, [F.desc(F.abs("correlation")), "order_a", "order_b"], pair_fields),
        "trend": first(a.trends, [F.desc(F.abs("total_pct_change")), "col_order"], trend_fields),
    }
    row |= first(a.segment_head, ["n_clusters"], ("n_clusters", "silhouette_score")) or {}
    return small_frame(df.sparkSession, [row], HEADLINE_DDL)


def top_anomaly(a: Analysis) -> DataFrame | None:
    """(total, row_index, column, value) of the first record."""
    if a.records is None or a.records.isEmpty():
        return None
    first = a.records.orderBy("record").limit(1)
    return first.select(F.lit(a.total_anomalies).alias("total"), "row_index", "column", "value")


def answers(df: DataFrame, a: Analysis, active_filters: dict[str, Any] | None = None, domain_name: str = "General Structured Dataset") -> DataFrame:
    """All answers for ``ask.answer_questions``; the analysis is of the unfiltered table."""
    positive = None
    if a.pairs is not None:
        best = stats.strongest(a.pairs).where(F.col("direction") == "positive")
        positive = settle(best)
    return possible_answers(df, a.types, positive, a.trends, top_anomaly(a), active_filters, domain_name)


def _as_json(df: DataFrame, order: list | None = None) -> str:
    """A small result table as a JSON array."""
    rows = df.orderBy(*order) if order else df
    return "[" + ",".join(r[0] for r in rows.select(F.to_json(F.struct("*"))).collect()) + "]"


def dashboard(df: DataFrame, dataset_id: str, quality_score: float | None = None, a: Analysis | None = None) -> DataFrame:
    """Everything a dashboard shows, as rows (dataset_id, section, position, content JSON)."""
    df = with_row_id(df)
    a = a or analyse(df)
    spark, types = df.sparkSession, a.types
    domain = classify_domain(domain_scores(df)).first()
    quality = kpi.DEFAULT_QUALITY if quality_score is None else quality_score
    related = a.significant is not None and not a.significant.isEmpty()
    specs = recommend.recommend(types, recommend.best_pair(a.significant) if related else None)
    summary = insight.executive_summary(headline(df, a, domain["domain_name"], quality))
    sections = {
        "columns": (lambda: column_types(df), ["col_order"]),
        "summary": (lambda: summary, []),
        "kpis": (lambda: kpi.kpis(df, types, quality), ["position"]),
        "filters": (lambda: kpi.filter_catalogue(df, types), ["filter_order"]),
        "charts": (lambda: recommend.spec_frame(spark, specs), ["chart_order"]),
        "suggested_questions": (
            lambda: question_frame(spark, suggested_questions(types, a.total_anomalies, related)),
            ["position"],
        ),
    }
    if a.has_facts():
        sections["insights"] = (lambda: insight.prioritise(insight.insight_cards(a.facts())), [])
    if a.pairs is not None:
        sections["what_if_drivers"] = (lambda: stats.what_if_options(a.pairs), [])
    if a.records is not None:
        sections["detailed_anomalies"] = (lambda: a.records, ["record"])
    if a.segments is not None:
        sections["clusters"] = (lambda: a.segments, ["cluster"])
    for i, s in enumerate(specs):
        sections[f"chart_{i + 1}_{s.kind}"] = (lambda s=s: recommend.chart_data(df, s, types, a.pairs), [])
    contents = run_together({k: (lambda make=make, order=order: _as_json(make(), order)) for k, (make, order) in sections.items()})
    # fixed value: the form of the title
    rows = [("title", f'"{domain["domain_name"]} Dashboard"'), ("domain", _as_json(spark.createDataFrame([domain]), []))]
    rows += list(contents.items())
    data = [(dataset_id, i, name, content) for i, (name, content) in enumerate(rows)]
    return spark.createDataFrame(data, "dataset_id string, position int, section string, content string")
