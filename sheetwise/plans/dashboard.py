"""Automatic dashboards and chart recommendations."""

from __future__ import annotations

import re
from itertools import combinations, zip_longest

from pyspark.sql import DataFrame

from sheetwise.functions.columns import data_fields
from sheetwise.operators.charts import all_charts
from sheetwise.operators.schema import classify
from sheetwise.operators.stats import correlation, distinct_labels, timeline, value_counts
from sheetwise.operators.histogram import histogram

# Fixed value: names that look like identifiers are no good chart category.
IDENTIFIER = re.compile(r"(^id$|_id$|uuid$)", re.IGNORECASE)

MAX_CHARTS = 8
PIE_LABELS = 10

SPEC_SCHEMA = (
    "position int, type string, title string, x string, y string, column string, "
    "aggregation string"
)


def label_totals(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Different labels per text column; one driver row per column."""
    found = {row["column"]: row["labels"] for row in distinct_labels(df, columns).collect()}
    return {name: found.get(name, 0) for name in columns}


def category_column(columns: list[str], totals: dict[str, int]) -> str | None:
    """Column with fewest labels that is no identifier; if all are, the first."""
    usable = [c for c in columns if not IDENTIFIER.search(c)]
    if usable:
        return min(usable, key=lambda c: totals[c])
    return columns[0] if columns else None


def auto_dashboard(df: DataFrame) -> list[dict]:
    """Charts chosen from the column classes: {type, title, column, data}."""
    found = classify(df)
    charts = []

    def add(kind, title, column, data):
        charts.append({"type": kind, "title": title, "column": column, "data": data})

    if found["numeric"]:
        name = found["numeric"][0]
        add("histogram", f"Distribution of {name}", name, histogram(df, name))
    if found["categorical"]:
        name = category_column(found["categorical"], label_totals(df, found["categorical"]))
        add("bar", f"Frequency of {name}", name, value_counts(df, [name]))
    if found["datetime"]:
        name = found["datetime"][0]
        add("line", f"Rows per day of {name}", name, timeline(df, name))
    if len(found["numeric"]) >= 2:
        add("heatmap", "Correlation", None, correlation(df))
    return charts


def recommend_charts(df: DataFrame) -> list[dict]:
    """Up to eight chart specs by rule, using only existing columns."""
    found = classify(df)
    numbers = [n for n in found["numeric"] if not IDENTIFIER.search(n)] or found["numeric"]
    dates, texts = found["datetime"], found["categorical"]
    totals = label_totals(df, texts) if texts else {}
    category = category_column(texts, totals)
    usable = [c for c in texts if not IDENTIFIER.search(c)] or texts
    bars = [_spec("bar", f"{y} by {category}", x=category, y=y, aggregation="sum") for y in numbers if category]
    lines = [
        _spec("line", f"{y} over {d}", x=d, y=y, aggregation="sum") for d in dates for y in numbers
    ]
    scatters = [_spec("scatter", f"{a} and {b}", x=a, y=b) for a, b in combinations(numbers, 2)]
    histograms = [_spec("histogram", f"Distribution of {n}", column=n) for n in numbers]
    pies = [
        _spec("pie", f"Share of {c}", column=c)
        for c in texts
        if 0 < totals[c] <= PIE_LABELS and not IDENTIFIER.search(c)
    ]
    columns = [f.name for f in data_fields(df)]
    others = {c: next((o for o in columns if o != c), None) for c in usable}
    counts = [_spec("bar", f"{o} counted by {c}", x=c, y=o, aggregation="count") for c, o in others.items() if o]
    # the best of each kind first, then columns that no chart has yet, then other pairs in turn
    specs = [*bars[:2], *lines[:1], *scatters[:1], *histograms[:2], *pies]
    kinds = [bars[2:], lines[1:], scatters[1:], histograms[2:], counts]
    rest = [spec for turn in zip_longest(*kinds) for spec in turn if spec]
    used = {name for spec in specs for name in _columns(spec)}
    fresh = []
    for spec in rest:
        if not used.issuperset(_columns(spec)):
            fresh.append(spec)
            used.update(_columns(spec))
    return [*specs, *fresh, *[spec for spec in rest if spec not in fresh]][:MAX_CHARTS]


def _columns(spec: dict) -> set[str]:
    return {spec[role] for role in ("x", "y", "column") if role in spec}


def _spec(kind: str, title: str, **roles: str) -> dict:
    return {"type": kind, "title": title, **roles}


def chart_specs(df: DataFrame) -> DataFrame:
    """The recommended charts as rows."""
    roles = ("type", "title", "x", "y", "column", "aggregation")
    rows = [(i, *[s.get(r) for r in roles]) for i, s in enumerate(recommend_charts(df))]
    return df.sparkSession.createDataFrame(rows, SPEC_SCHEMA)


def recommended_dashboard(df: DataFrame) -> list[dict]:
    """Data for every recommended chart."""
    return all_charts(df, recommend_charts(df))
