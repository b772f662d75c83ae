"""Chart data and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sheetwise.catalog.registry import (
    DIRTY_LINEITEM, ORDERS_WITH_GAPS, dirty_lineitem, orders_with_gaps, query, table,
)
from sheetwise.catalog.statistics import histogram_sql
from sheetwise.operators.charts import all_charts, chart
from sheetwise.operators.stats import timeline as rows_per_day
from sheetwise.plans import dashboard


@query(f"""
WITH {DIRTY_LINEITEM}
SELECT l_returnflag AS label, round(coalesce(sum(l_extendedprice), 0), 2) AS value FROM dirty
WHERE l_returnflag IS NOT NULL GROUP BY 1
""")
def bar_chart(spark, sf_dir):
    spec = {"type": "bar", "title": "Revenue", "x": "l_returnflag", "y": "l_extendedprice"}
    return chart(dirty_lineitem(spark, sf_dir), spec).withColumn("value", F.round("value", 2))


@query("SELECT o_orderdate AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def line_chart(spark, sf_dir):
    spec = {"type": "line", "x": "o_orderdate", "y": "o_totalprice", "aggregation": "sum"}
    return chart(table(spark, sf_dir, "orders"), spec).withColumn("value", F.round("value", 2))


@query(f"WITH {ORDERS_WITH_GAPS} SELECT o_orderstatus AS name, count(*) AS value FROM gaps GROUP BY 1")
def pie_chart(spark, sf_dir):
    return chart(orders_with_gaps(spark, sf_dir), {"type": "pie", "column": "o_orderstatus"})


@query(f"""
WITH {DIRTY_LINEITEM}
SELECT l_quantity AS x, l_discount AS y FROM dirty
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL
""")
def scatter_chart(spark, sf_dir):
    spec = {"type": "scatter", "x": "l_quantity", "y": "l_discount"}
    return chart(dirty_lineitem(spark, sf_dir), spec)


@query(histogram_sql("", "part", "p_retailprice"))
def histogram_chart(spark, sf_dir):
    data = chart(table(spark, sf_dir, "part"), {"type": "histogram", "column": "p_retailprice"})
    edges = {n: F.round(n, 6) + F.lit(0.0) for n in ("lo", "hi")}
    return data.withColumns(edges).select(F.col("number").alias("bin"), "lo", "hi", "count")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS label, count(*) AS value FROM events GROUP BY 1")
def timeline(spark, sf_dir):
    return rows_per_day(table(spark, sf_dir, "events"), "ts")


CHECKED_SPECS = [
    {"type": "bar", "title": "ok", "x": "o_orderstatus", "y": "o_totalprice"},
    {"type": "bar", "title": "same", "x": "o_totalprice", "y": "o_totalprice"},
    {"type": "line", "title": "unknown", "x": "o_orderdate", "y": "nope"},
    {"type": "pie", "title": "ok", "column": "o_orderpriority"},
    {"type": "scatter", "title": "text", "x": "o_orderstatus", "y": "o_totalprice"},
    {"type": "histogram", "title": "empty", "column": "o_nothing"},
    {"type": "radar", "title": "kind", "column": "o_orderstatus"},
]


NO_DATA = "CAST(NULL AS VARCHAR) AS label, CAST(NULL AS DOUBLE) AS number"


def _failed(position: int, kind: str, title: str) -> str:
    return f"SELECT {position} AS position, '{kind}' AS type, '{title}' AS title, {NO_DATA}, true AS failed"


def _data(position: int, kind: str, title: str, label: str, number: str, source: str) -> str:
    return (
        f"SELECT {position} AS position, '{kind}' AS type, '{title}' AS title, CAST({label} AS VARCHAR) AS label, "
        f"CAST({number} AS DOUBLE) AS number, false AS failed FROM {source}"
    )


def _binned(column: str) -> str:
    """Labels and counts of the ten bins."""
    bins = histogram_sql("", "orders", column).replace("round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi", "lo, hi")
    return f"(SELECT printf('%.2f-%.2f', lo, hi) AS label, count FROM ({bins}))"


def _chart_rows(position: int, result: dict):
    """The data of a chart as (label, number), whatever its kind."""
    names = {"pie": ("name", "value"), "scatter": ("x", "y"), "histogram": ("bin", "count")}
    label, number = (F.col(n) for n in names.get(result["type"], ("label", "value")))
    label = label.cast("bigint") if result["type"] == "scatter" else label
    return result["data"].select(
        F.lit(position).alias("position"), F.lit(result["type"]).alias("type"), F.lit(result["title"]).alias("title"),
        label.cast("string").alias("label"), F.round(number.cast("double"), 2).alias("number"), F.lit(False).alias("failed"),
    )


@query(" UNION ALL ".join([
    _data(0, "bar", "ok", "o_orderstatus", "round(sum(o_totalprice), 2)", "orders GROUP BY o_orderstatus"),
    _failed(1, "bar", "same"),
    _failed(2, "line", "unknown"),
    _data(3, "pie", "ok", "o_orderpriority", "count(*)", "orders GROUP BY o_orderpriority"),
    _failed(4, "scatter", "text"),
    _failed(5, "histogram", "empty"),
    _failed(6, "radar", "kind"),
]))
def all_charts_with_failures(spark, sf_dir):
    """Every value of the charts; a chart that failed is a row without one."""
    orders = table(spark, sf_dir, "orders").withColumn("o_nothing", F.lit(None).cast("double"))
    results = list(enumerate(all_charts(orders, CHECKED_SPECS)))
    failed = [(i, r["type"], r["title"], None, None, True) for i, r in results if "error" in r]
    schema = "position int, type string, title string, label string, number double, failed boolean"
    rows = [_chart_rows(i, r) for i, r in results if "error" not in r]
    return reduce(lambda a, b: a.unionByName(b), rows, spark.createDataFrame(failed, schema))


def _histogram_rows(column: str) -> str:
    return f"(SELECT 'histogram' AS chart, CAST(bin AS VARCHAR) AS label, CAST(count AS DOUBLE) AS value FROM ({histogram_sql('', 'orders', column)}))"


@query(f"""
{_histogram_rows("o_orderkey")}
UNION ALL
SELECT 'bar', o_orderstatus, CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 'line', strftime(o_orderdate, '%Y-%m-%d'), CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2
UNION ALL
""" + " UNION ALL ".join(
    f"SELECT 'heatmap', '{a}/{b}', round(corr({a}, {b}), 6) + 0.0 FROM orders"
    for a in ("o_orderkey", "o_custkey", "o_totalprice")
    for b in ("o_orderkey", "o_custkey", "o_totalprice")
))
def auto_dashboard(spark, sf_dir):
    """All automatic charts of the orders as (chart, label, value)."""
    shapes = {
        "histogram": (F.col("bin").cast("string"), F.col("count")),
        "bar": (F.col("label"), F.col("count")),
        "line": (F.date_format("label", "yyyy-MM-dd"), F.col("value")),
        "heatmap": (F.concat_ws("/", "col_a", "col_b"), F.round("corr", 6) + F.lit(0.0)),
    }
    parts = []
    for found in dashboard.auto_dashboard(table(spark, sf_dir, "orders")):
        label, value = shapes[found["type"]]
        parts.append(
            found["data"].select(
                F.lit(found["type"]).alias("chart"),
                label.alias("label"),
                value.cast("double").alias("value"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""
WITH totals AS (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders),
named AS (SELECT CASE WHEN s <= p THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS c, s, p FROM totals),
specs AS (
  SELECT 0 AS position, 'bar' AS type, 'o_orderkey by ' || c AS title, c AS x, 'o_orderkey' AS y, NULL AS "column", 'sum' AS aggregation FROM named
  UNION ALL SELECT 1, 'bar', 'o_custkey by ' || c, c, 'o_custkey', NULL, 'sum' FROM named
  UNION ALL SELECT 2, 'line', 'o_orderkey over o_orderdate', 'o_orderdate', 'o_orderkey', NULL, 'sum'
  UNION ALL SELECT 3, 'scatter', 'o_orderkey and o_custkey', 'o_orderkey', 'o_custkey', NULL, NULL
  UNION ALL SELECT 4, 'histogram', 'Distribution of o_orderkey', NULL, NULL, 'o_orderkey', NULL
  UNION ALL SELECT 5, 'histogram', 'Distribution of o_custkey', NULL, NULL, 'o_custkey', NULL
  UNION ALL SELECT 6, 'pie', 'Share of o_orderstatus', NULL, NULL, 'o_orderstatus', NULL FROM named WHERE s <= 10
  UNION ALL SELECT 7, 'pie', 'Share of o_orderpriority', NULL, NULL, 'o_orderpriority', NULL FROM named WHERE p <= 10)
SELECT * FROM specs
""")
def chart_recommendation(spark, sf_dir):
    return dashboard.chart_specs(table(spark, sf_dir, "orders"))


RECOMMENDED = [
    _data(0, "bar", "o_orderkey by o_orderstatus", "o_orderstatus", "sum(o_orderkey)", "orders GROUP BY o_orderstatus"),
    _data(1, "bar", "o_custkey by o_orderstatus", "o_orderstatus", "sum(o_custkey)", "orders GROUP BY o_orderstatus"),
    _data(2, "line", "o_orderkey over o_orderdate", "o_orderdate", "sum(o_orderkey)", "orders GROUP BY o_orderdate"),
    _data(3, "scatter", "o_orderkey and o_custkey", "o_orderkey", "o_custkey", "orders"),
    _data(4, "histogram", "Distribution of o_orderkey", "label", "count", _binned("o_orderkey")),
    _data(5, "histogram", "Distribution of o_custkey", "label", "count", _binned("o_custkey")),
    _data(6, "pie", "Share of o_orderstatus", "o_orderstatus", "count(*)", "orders GROUP BY o_orderstatus"),
    _data(7, "pie", "Share of o_orderpriority", "o_orderpriority", "count(*)", "orders GROUP BY o_orderpriority"),
]


@query(" UNION ALL ".join(RECOMMENDED))
def recommended_dashboard(spark, sf_dir):
    """Every value of the recommended charts."""
    charts = dashboard.recommended_dashboard(table(spark, sf_dir, "orders"))
    return reduce(lambda a, b: a.unionByName(b), [_chart_rows(i, r) for i, r in enumerate(charts)])
