"""Chart data from a chart specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.columns import as_double, present
from sheetwise.operators.histogram import histogram, histograms
from sheetwise.operators.schema import column_class
from sheetwise.operators.stats import group_aggregate

HISTOGRAM = "number int, lo double, hi double, bin string, count bigint"
NOT_AVAILABLE = "The chart could not be made from these columns."


class ChartError(ValueError):
    """The specification does not fit the table."""


def chart(df: DataFrame, spec: dict) -> DataFrame:
    """Chart data for a spec {type, title, x, y, column, aggregation}.

    bar, line: (label, value); pie: (name, value); scatter: (x, y); histogram: (bin, count).
    The spec is checked against the schema before any job.
    """
    kind = spec.get("type", "")
    if kind not in CHARTS:
        raise ChartError(f"Unknown chart type: {kind!r}")
    return CHARTS[kind](df, spec)


def _column(df: DataFrame, spec: dict, role: str) -> str:
    name = spec.get(role)
    if not name:
        raise ChartError(f"{spec['type']} needs {role!r}")
    if name not in df.columns:
        raise ChartError(f"Unknown column: {name!r}")
    return name


def _numeric(df: DataFrame, name: str) -> str:
    if column_class(df.schema[name].dataType, bool_as_numeric=True) != "numeric":
        raise ChartError(f"Not a numeric column: {name!r}")
    return name


def _two_columns(df: DataFrame, spec: dict) -> tuple[str, str]:
    x, y = _column(df, spec, "x"), _column(df, spec, "y")
    if x == y:
        raise ChartError("x and y are the same column")
    return x, y


def grouped_chart(df: DataFrame, spec: dict) -> DataFrame:
    x, y = _two_columns(df, spec)
    try:
        return group_aggregate(df, x, y, spec.get("aggregation") or "sum")
    except ValueError as error:
        raise ChartError(str(error)) from error


def pie_chart(df: DataFrame, spec: dict) -> DataFrame:
    """Rows per label, missing included, most frequent first."""
    name = _column(df, spec, "column")
    counted = df.groupBy(present(df.schema[name]).alias("name"))
    counted = counted.agg(F.count(F.lit(1)).alias("value"))
    return counted.orderBy(F.desc("value"), F.asc_nulls_last("name"))


def scatter_chart(df: DataFrame, spec: dict) -> DataFrame:
    """Every pair of values that is complete."""
    x, y = (_numeric(df, name) for name in _two_columns(df, spec))
    points = df.select(as_double(df.schema[x]).alias("x"), as_double(df.schema[y]).alias("y"))
    return points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def histogram_chart(df: DataFrame, spec: dict) -> DataFrame:
    """Ten bins; `number`, `lo` and `hi` come along for sorting and checking."""
    name = _numeric(df, _column(df, spec, "column"))
    return histogram(df, name, 10).select(
        F.col("bin").alias("number"), "lo", "hi", F.col("label").alias("bin"), "count"
    )


CHARTS = {
    "bar": grouped_chart,
    "line": grouped_chart,
    "pie": pie_chart,
    "scatter": scatter_chart,
    "histogram": histogram_chart,
}


def all_charts(df: DataFrame, specs: list[dict]) -> list[dict]:
    """One {type, title, data} per spec, in order; a failed one has data None and an error.

    All histograms together take one pair of passes, made here: ten rows per column come to the driver.
    """
    results, checked = [], []
    for spec in specs:
        result = {"type": spec.get("type", "unknown"), "title": spec.get("title", ""), "data": None}
        try:
            if result["type"] == "histogram":
                checked.append((result, _numeric(df, _column(df, spec, "column"))))
            else:
                result["data"] = chart(df, spec)
        except ChartError as error:
            result["error"] = f"{NOT_AVAILABLE} {error}"
        results.append(result)
    rows: dict[str, list] = {}
    for row in histograms(df, list(dict.fromkeys(n for _, n in checked)), 10, strict=False).collect() if checked else []:
        rows.setdefault(row["column"], []).append((row["bin"], row["lo"], row["hi"], row["label"], row["count"]))
    for result, name in checked:
        if name in rows:
            result["data"] = df.sparkSession.createDataFrame(rows[name], HISTOGRAM)
        else:
            result["error"] = f"{NOT_AVAILABLE} The column has no values that can be cut into bins"
    return results
