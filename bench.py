"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default: the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sheetlens import build_session  # noqa: E402
from sheetlens.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "profile_columns_lineitem", "numeric_stats_orders", "top_categories_part", "duplicate_rows_messy", "sample_values_part",
    "domain_class", "filter_apply_range", "search_rows_part", "filter_catalogue_orders",
    "bar_sum_returnflag", "pie_share_priority", "histogram_extendedprice", "box_totalprice", "line_series_orders",
    "corr_matrix_lineitem", "whatif_price_revenue", "kpi_row_orders", "slicer_recompute_box",
    "univariate_outliers_lineitem", "anomaly_records_iqr", "trend_lineitem", "period_anomaly_orders",
    "iforest_flags", "kmeans_profile", "clean_all_steps", "insights_priority", "question_intent", "answer_questions",
    "dashboard_bundle",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("sheetlens-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bar_sum_returnflag"](spark, sf_dir).collect()  # start the JVM's and Spark's lazy parts
    tracker = spark.sparkContext.statusTracker()
    seconds, jobs = {}, {}
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        jobs[name] = len(tracker.getJobIdsForGroup(name))
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "jobs": jobs,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
