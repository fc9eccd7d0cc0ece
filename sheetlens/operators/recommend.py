"""Which charts suit a table, decided from column types and correlations alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.names import is_measure_name
from sheetlens.operators import charts, stats
from sheetlens.operators.profile import TableTypes
from sheetlens.session import small_frame

# Importances, category ranges and limits per chart type.
IMPORTANCE = {
    "line": 0.98,
    "bar": 0.88,
    "horizontal_bar": 0.82,
    "histogram": 0.78,
    "box_plot": 0.74,
    "heatmap": 0.72,
    "pie": 0.68,
    "scatter": 0.65,
}
CHART_CATEGORIES, BAR_CATEGORIES, PIE_CATEGORIES = (2, 30), (3, 8), (2, 6)
SCATTER_MIN_R, HEATMAP_MIN_COLUMNS, BOX_MIN_ROWS = 0.45, 3, 10
MAX_CHARTS = 8


@dataclass
class ChartSpec:
    kind: str
    x: str | None
    y: tuple[str, ...]
    title: str

    @property
    def importance(self) -> float:
        return IMPORTANCE[self.kind]


def _within(n: int, limits: tuple[int, int]) -> bool:
    return limits[0] <= n <= limits[1]


def recommend(types: TableTypes, best_pair: tuple[str, str, float] | None) -> list[ChartSpec]:
    """Charts by importance, at most one of a kind (two bars) and eight in all."""
    unique = {c.name: c.unique for c in types.columns}
    cats = [c for c in types.categorical if _within(unique[c], CHART_CATEGORIES)]
    nums = types.numerical
    measures = [c for c in nums if is_measure_name(c)] or nums
    main = measures[0] if measures else None
    second = measures[1] if len(measures) > 1 else (nums[1] if len(nums) > 1 else None)
    # fixed values: the chart titles
    out: list[ChartSpec] = []
    if types.date_column and main:
        shown = tuple(measures[:2])
        title = f"{main} Trajectory" if len(shown) == 1 else "Performance Trend Over Time"
        out.append(ChartSpec("line", types.date_column, shown, title))
    bar_cat = next((c for c in cats if _within(unique[c], BAR_CATEGORIES)), cats[0] if cats else None)
    if bar_cat and main:
        out.append(ChartSpec("bar", bar_cat, (main,), f"{main} by {bar_cat}"))
    rank_cat = next((c for c in cats if c != bar_cat), bar_cat)
    spread = second or main
    if rank_cat and spread:
        out.append(ChartSpec("horizontal_bar", spread, (rank_cat,), f"Top Rankings: {spread} by {rank_cat}"))
    if main:
        out.append(ChartSpec("histogram", main, ("count",), f"Distribution: {main}"))
    if spread and types.rows >= BOX_MIN_ROWS:
        out.append(ChartSpec("box_plot", spread, (spread,), f"Quartile Spread: {spread}"))
    if len(nums) >= HEATMAP_MIN_COLUMNS:
        out.append(ChartSpec("heatmap", None, (), "Correlation Matrix Heatmap"))
    slices = [c for c in cats if _within(unique[c], PIE_CATEGORIES)]
    pie_cat = next((c for c in slices if c != bar_cat), slices[0] if slices else None)
    if pie_cat and main:
        out.append(ChartSpec("pie", pie_cat, (main,), f"Proportion of {main} by {pie_cat}"))
    if best_pair and abs(best_pair[2]) >= SCATTER_MIN_R:
        a, b, r = best_pair
        out.append(ChartSpec("scatter", a, (b,), f"{a} vs {b} (r = {r:+.2f})"))
    return out[:MAX_CHARTS]


def best_pair(significant: DataFrame) -> tuple[str, str, float] | None:
    """The strongest significant pair."""
    row = significant.orderBy(F.desc(F.abs("correlation")), "order_a", "order_b").first()
    return None if row is None else (row["column_a"], row["column_b"], row["correlation"])


def spec_frame(spark, specs: list[ChartSpec]) -> DataFrame:
    rows = [
        {"chart_order": i + 1, "type": s.kind, "x": s.x, "y": ",".join(s.y), "title": s.title, "importance": s.importance}
        for i, s in enumerate(specs)
    ]
    return small_frame(spark, rows, "chart_order int, type string, x string, y string, title string, importance double")


def chart_data(df: DataFrame, spec: ChartSpec, types: TableTypes, pairs: DataFrame) -> DataFrame:
    """The series behind one chart."""
    match spec.kind:
        case "line":
            return charts.line(df, types.time(df), list(spec.y))
        case "bar":
            return charts.bar(df, spec.x, spec.y[0])
        case "horizontal_bar":
            return charts.ranking(df, spec.y[0], spec.x)
        case "histogram":
            return charts.histogram(df, spec.x)
        case "box_plot":
            return charts.box(df, spec.x)
        case "heatmap":
            return stats.correlation_matrix(pairs)
        case "pie":
            return charts.pie(df, spec.x, spec.y[0])
    return charts.scatter(df, spec.x, spec.y[0])
