from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from sheetwise.operators.charts import ChartError, all_charts, chart
from sheetwise.operators.histogram import histogram, histograms
from sheetwise.plans import analysis, dashboard

SPEC_ERRORS = [
    {},
    {"type": "radar", "column": "k"},
    {"type": "bar", "x": "k"},
    {"type": "bar", "x": "k", "y": "nope"},
    {"type": "line", "x": "v", "y": "v"},
    {"type": "bar", "x": "v", "y": "k", "aggregation": "mean"},
    {"type": "scatter", "x": "k", "y": "v"},
    {"type": "scatter", "x": "v", "y": "v"},
    {"type": "histogram", "column": "k"},
    {"type": "pie", "column": ""},
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [("b", 1.0, True), ("a", None, False), (None, 3.0, None), ("a", 5.0, True)],
        "k string, v double, flag boolean",
    )


@pytest.mark.parametrize("spec", SPEC_ERRORS)
def test_bad_specs(df, spec):
    with pytest.raises(ChartError):
        chart(df, spec)


def test_chart_shapes(df):
    def rows(spec):
        return [tuple(r) for r in chart(df, spec).collect()]

    assert rows({"type": "bar", "x": "k", "y": "v"}) == [("a", 5.0), ("b", 1.0)]
    assert rows({"type": "line", "x": "k", "y": "v", "aggregation": "count"}) == [("a", 1.0), ("b", 1.0)]
    assert rows({"type": "bar", "x": "k", "y": "flag", "aggregation": "mean"}) == [("a", 0.5), ("b", 1.0)]
    assert rows({"type": "pie", "column": "k"}) == [("a", 2), ("b", 1), (None, 1)]
    assert sorted(rows({"type": "scatter", "x": "v", "y": "flag"})) == [(1.0, 1.0), (5.0, 1.0)]
    counts = [r[-1] for r in rows({"type": "histogram", "column": "v"})]
    assert counts == [1, 0, 0, 0, 1, 0, 0, 0, 0, 1]


def test_failures_keep_their_place(spark, df):
    empty = df.selectExpr("*", "cast(null as double) as e")
    found = all_charts(empty, [
        {"type": "bar", "title": "one", "x": "k", "y": "v"},
        {"type": "histogram", "title": "two", "column": "e"},
        {"title": "three"},
    ])
    assert [f["title"] for f in found] == ["one", "two", "three"]
    assert "error" not in found[0] and found[0]["data"].count() == 2
    assert found[1]["data"] is None and "no values" in found[1]["error"]
    assert found[2]["type"] == "unknown" and "error" in found[2]


def test_category_choice():
    totals = {"id": 2, "user_id": 1, "city": 9, "land": 9}
    assert dashboard.category_column(["id", "user_id", "city", "land"], totals) == "city"
    assert dashboard.category_column(["id", "user_id"], totals) == "id"
    assert dashboard.category_column([], {}) is None


def test_automatic_charts_depend_on_the_classes(spark, df):
    kinds = [c["type"] for c in dashboard.auto_dashboard(df)]
    assert kinds == ["histogram", "bar"]
    assert dashboard.auto_dashboard(spark.sql("select array(1) a")) == []


def test_recommended_charts_use_existing_columns(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    specs = dashboard.recommend_charts(orders)
    assert 2 <= len(specs) <= 8
    assert all(s[r] in orders.columns for s in specs for r in ("x", "y", "column") if r in s)
    assert not any("error" in r for r in all_charts(orders, specs))


def test_context_document(spark):
    df = spark.createDataFrame(
        [(1, "a", True), (2, None, False), (4, "a", None)], "n int, s string, b boolean"
    )
    context = json.loads(analysis.context_json(df).first()["context"])
    assert (context["total_rows"], context["total_columns"]) == (3, 3)
    assert context["column_names"] == ["n", "s", "b"]
    assert [s["column"] for s in context["numeric_statistics"]] == ["n", "b"]
    assert context["numeric_statistics"][0] == {
        "column": "n", "mean": 2.33, "median": 2.0, "min": 1.0, "max": 4.0, "std": 1.53,
    }
    assert context["missing_values"][1] == {"column": "s", "missing": 1, "missing_pct": 33.33}
    assert context["top_categories"] == [
        {"column": "s", "label": "a", "count": 2}, {"column": "s", "label": None, "count": 1},
    ]
    assert len(context["correlation_matrix"]) == 4 and len(context["sample"]) == 3


def test_last_turns_limit_before_the_shuffle(spark, plan_of):
    df = spark.range(1000).selectExpr("if(id < 900, 0, id) as conv_id", "id as turn", "'x' as text")
    found = analysis.last_turns(df)
    assert found.count() == 6 + 100
    assert "WindowGroupLimit" in plan_of(found)


def test_no_python_in_plans(spark, plan_of):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for part in analysis.analyze(orders).values():
        plan = plan_of(part)
        assert "BatchEvalPython" not in plan and "InPandas" not in plan and "ArrowEval" not in plan
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_recommendations_use_all_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, f"t{i}") for i in range(20)], "a double, b double, c double, d double, s string")
    specs = dashboard.recommend_charts(df)
    assert len(specs) == dashboard.MAX_CHARTS
    used = {name for s in specs for name in (s.get("x"), s.get("y"), s.get("column")) if name}
    assert used == {"a", "b", "c", "d", "s"}


def test_text_only_table_gets_charts(spark):
    df = spark.createDataFrame([("x", "y")], "s string, t string")
    specs = dashboard.recommend_charts(df)
    assert 2 <= len(specs) <= 8
    assert all("error" not in r for r in dashboard.recommended_dashboard(df))


def test_histograms_share_two_passes(spark, plan_of):
    orders = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    names = ["l_extendedprice", "l_quantity", "l_discount", "l_orderkey"]
    found = histograms(orders, names, 10)
    assert plan_of(found).count("Scan parquet") <= 2  # one scan, named twice; the buckets are kept
    for name in names:
        one = [tuple(r) for r in histogram(orders, name, 10).collect()]
        assert [tuple(r)[1:] for r in found.filter(F.col("column") == name).collect()] == one


def test_histograms_of_odd_columns(spark):
    inf = float("inf")
    rows = [(float(i), None, 7.0, inf if i == 3 else 1.0, i * 1e-300, bool(i % 2), -(2.0**i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, empty double, same double, endless double, tiny double, flag boolean, wide double")
    names = ["a", "empty", "same", "endless", "tiny", "flag", "wide"]
    found = histograms(df, names, 7, strict=False).collect()
    for name in ("a", "same", "tiny", "flag", "wide"):
        assert [tuple(r)[1:] for r in found if r["column"] == name] == [tuple(r) for r in histogram(df, name, 7).collect()]
    assert {r["column"] for r in found} == {"a", "same", "tiny", "flag", "wide"}
    with pytest.raises(Exception, match="infinite"):
        histograms(df, names, 7).collect()
    charts_of = all_charts(df, [{"type": "histogram", "column": n} for n in names])
    assert [c["type"] for c in charts_of if "error" in c] == ["histogram"] * 2
