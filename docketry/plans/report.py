"""The markdown report: small results of the catalogue, formatted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.plans import catalog, derived

SECTIONS = {
    "Overview": "o19_report_overview", "Coverage": "o20_report_coverage", "Actions by state": "o21_report_by_state", "Largest settlements": "o22_largest_settlements", "Categories": "o24_report_categories", "Action types": "o25_report_types",
    "Money by category": "o27_money_by_category", "Quarterly trend": "o28_quarterly_trend", "Year over year": "o29_year_over_year", "Quality": "o30_quality_histogram",
}
#: Rows of a section, at most: a report shows tops.
ROWS = 50


def table(df: DataFrame, rows: int = ROWS) -> str:
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    got = df.limit(rows + 1).collect()
    body = ["| " + " | ".join("" if v is None else f"{v:,.2f}" if isinstance(v, float) else str(v).replace("|", "/") for v in r) + " |" for r in got[:rows]]
    return "\n".join([head, *body, *([f"\nThe first {rows} of {df.count():,} rows."] if len(got) > rows else [])])


def report(spark: SparkSession, root: str) -> str:
    q = catalog.QUERIES | derived.QUERIES
    return "# Enforcement actions\n\n" + "\n\n".join(f"## {title}\n\n{table(q[name](spark, root).orderBy(1))}" for title, name in SECTIONS.items()) + "\n"
