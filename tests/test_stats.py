from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheetwise.operators import quantiles, stats
from sheetwise.operators.histogram import histogram

LINES = "/root/testdata/sf0.001/lineitem.parquet"


def by_column(df, key="column"):
    return {r[key]: r for r in df.collect()}


# --- quantiles -------------------------------------------------------------------------

SHAPES = {
    "uniform": lambda r: r.uniform(-50, 50, 5000),
    "heavy tail": lambda r: r.lognormal(0, 40, 5000) * r.choice([-1, 1], 5000),
    "a third equal": lambda r: np.where(r.random(6000) < 0.34, 7.25, r.normal(7.25, 1e-9, 6000)),
    "close together": lambda r: 1.0 + r.integers(0, 4000, 5000) * 2.0**-52,
    "tiny": lambda r: r.integers(0, 300, 5000) * 5e-324,
    "integers": lambda r: r.integers(0, 10, 5001).astype(float),
    "two values": lambda r: np.where(r.random(999) < 0.5, -1e300, 1e300),
    "one value": lambda r: np.array([3.5]),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_quantiles_equal_numpy(spark, monkeypatch, shape, limit):
    """Small bucket limits force the splitting rounds that large tables need."""
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", limit)
    values = SHAPES[shape](np.random.default_rng(3))
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    row = stats.numeric_stats(df).first()
    wanted = np.quantile(values, [0.25, 0.5, 0.75])
    np.testing.assert_allclose([row["q1"], row["median"], row["q3"]], wanted, rtol=1e-12)
    assert (row["count"], row["min"], row["max"]) == (len(values), values.min(), values.max())


@pytest.mark.parametrize("size", [32 << 20, 0])
@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_grouped_median_with_a_hot_group(spark, monkeypatch, limit, size):
    """With and without the splitting rounds, with and without the broadcast."""
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", limit)
    monkeypatch.setattr(quantiles, "BROADCAST_BYTES", size)
    rng = np.random.default_rng(5)
    keys = np.where(rng.random(6000) < 0.4, 0, rng.integers(1, 50, 6000))
    frame = pd.DataFrame({"k": keys, "v": rng.normal(100, 10, 6000).round(2)})
    frame.loc[rng.random(6000) < 0.1, "v"] = None
    found = stats.group_aggregate(spark.createDataFrame(frame), "k", "v", "median").toPandas()
    wanted = frame.groupby("k")["v"].median()
    np.testing.assert_allclose(found["value"], wanted.to_numpy(), rtol=1e-12)
    assert list(found["label"]) == list(wanted.index)


def test_infinite_values_have_quantiles(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "v double")
    row = stats.numeric_stats(df).first()
    assert (row["median"], row["min"], row["max"]) == (1.5, float("-inf"), float("inf"))


# --- numeric and datetime statistics ---------------------------------------------------


def test_numeric_stats_equal_pandas(spark):
    df = spark.read.parquet(LINES).withColumn("gap", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    frame = df.toPandas()
    for name, row in by_column(stats.numeric_stats(df)).items():
        series = frame[name]
        assert row["count"] == series.count()
        assert row["median"] == pytest.approx(series.median())
        assert row["q3"] == pytest.approx(series.quantile(0.75))
        assert row["std"] == pytest.approx(series.std(), abs=0.0051)
        assert row["sum"] == pytest.approx(series.sum())


def test_stats_edge_columns(spark):
    df = spark.createDataFrame([(1, None, True)], "one int, none double, flag boolean")
    rows = by_column(stats.numeric_stats(df))
    assert rows["one"]["std"] is None and rows["one"]["median"] == 1.0
    assert (rows["none"]["count"], rows["none"]["median"], rows["none"]["sum"]) == (0, None, 0.0)
    assert [r["column"] for r in stats.context_stats(df).orderBy("position").collect()] == [
        "one", "none", "flag",
    ]
    empty = by_column(stats.numeric_stats(df.limit(0)))
    assert empty["one"]["count"] == 0 and empty["one"]["mean"] is None
    assert stats.numeric_stats(df.select("flag")).count() == 0


def test_approximate_stats_are_close(spark):
    df = spark.read.parquet(LINES).select("l_extendedprice")
    exact, near = stats.numeric_stats(df).first(), stats.numeric_stats(df, approx=True).first()
    assert near["median"] == pytest.approx(exact["median"], rel=0.01)
    assert near["count"] == exact["count"]


def test_datetime_stats(spark):
    df = spark.sql(
        "select * from values (timestamp_ntz'2024-01-02', date'2024-01-01'), "
        "(timestamp_ntz'2024-01-02', null), (null, null) as t(a, b)"
    )
    rows = by_column(stats.datetime_stats(df))
    assert rows["a"].asDict() == {
        "column": "a", "min_date": "2024-01-02 00:00:00", "max_date": "2024-01-02 00:00:00",
        "total_records": 2, "unique_dates": 1,
    }
    assert rows["b"]["unique_dates"] == 1


# --- correlation -----------------------------------------------------------------------


def pairs(df, **options):
    return {(r["col_a"], r["col_b"]): r["corr"] for r in stats.correlation(df, **options).collect()}


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 1), (2.0, None, 2), (None, 9.0, 3), (4.0, 8.0, 5)], "a double, b double, c int"
    )
    found = pairs(df)
    assert found["a", "b"] == pytest.approx(1.0)
    assert found["a", "c"] == pytest.approx(0.995871, abs=1e-6)
    assert found["c", "b"] == pytest.approx(0.792406, abs=1e-6)
    assert found["a", "a"] == 1.0 and len(found) == 9


def test_constant_column_has_no_correlation(spark):
    found = pairs(spark.createDataFrame([(0.1, 1), (0.1, 2), (0.1, 3)], "a double, b int"))
    assert found["a", "a"] is None and found["a", "b"] is None and found["b", "b"] == 1.0


def test_constant_on_the_common_rows(spark):
    df = spark.createDataFrame([(0.1, 1), (0.1, 2), (0.1, 4), (7.0, None)], "a double, b int")
    assert pairs(df)["a", "b"] is None


def test_pair_without_common_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 1.0), (None, 3.0)], "a double, b double")
    found = pairs(df)
    assert found["a", "b"] is None and found["b", "b"] == 1.0


def test_correlation_far_from_zero(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": 1e9 + rng.normal(size=3000), "c": rng.normal(size=3000)})
    frame["b"] = frame["a"] * 0.5 + rng.normal(size=3000)
    found = pairs(spark.createDataFrame(frame))
    wanted = np.corrcoef(frame["a"] - 1e9, frame["b"] - 5e8)[0, 1]
    assert found["a", "b"] == pytest.approx(wanted, abs=1e-12)


def test_wide_correlation_equals_pandas(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(200, 19)), columns=[f"c{i}" for i in range(19)])
    frame.loc[frame["c3"] > 1, "c4"] = None
    found, wanted = pairs(spark.createDataFrame(frame)), frame.corr()
    assert len(found) == 19 * 19
    for (a, b), value in found.items():
        assert value == pytest.approx(wanted[a][b], abs=1e-9) and value == found[b, a]


def test_correlation_needs_two_columns(spark):
    assert pairs(spark.range(3)) == {}


# --- histogram -------------------------------------------------------------------------


def bins(df, column, n=10):
    return [tuple(r) for r in histogram(df, column, n).select("lo", "hi", "count").collect()]


def test_histogram_0_to_100(spark):
    found = bins(spark.range(101), "id")
    assert [c for _, _, c in found] == [11] + [10] * 9
    assert found[0][0] == pytest.approx(-0.1)


@pytest.mark.parametrize("value", [5, 0, -5])
def test_histogram_of_a_constant(spark, value):
    found = bins(spark.range(4).select(F.lit(value).alias("x")), "x")
    margin = 0.001 * abs(value) or 0.001
    assert [c for _, _, c in found] == [0, 0, 0, 0, 4, 0, 0, 0, 0, 0]
    assert (found[0][0], found[-1][1]) == pytest.approx((value - margin, value + margin))


@pytest.mark.parametrize("name", ["l_discount", "l_extendedprice", "l_tax", "l_quantity"])
@pytest.mark.parametrize("n", [1, 7, 10, 64])
def test_histogram_equals_pandas(spark, name, n):
    df = spark.read.parquet(LINES)
    series = df.select(name).toPandas()[name]
    cut, edges = pd.cut(series, bins=n, retbins=True)
    found = bins(df, name, n)
    assert [c for _, _, c in found] == list(cut.value_counts().sort_index())
    np.testing.assert_allclose([found[0][0]] + [hi for _, hi, _ in found], edges, atol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 10, 37])
def test_histogram_of_close_values(spark, n):
    """Bins about as wide as the gap between doubles, where lowering the first edge by 0.1 %
    of the range changes nothing; the minimum still belongs to bin 1."""
    series = pd.Series(1e15 + np.arange(9).repeat(range(1, 10)) * 0.125)
    edges = np.linspace(series.min(), series.max(), n + 1)
    numbers = np.maximum(np.searchsorted(edges, series, side="left"), 1)
    found = bins(spark.createDataFrame(series.to_frame("x")), "x", n)
    assert [c for _, _, c in found] == list(np.bincount(numbers, minlength=n + 1)[1:])


def test_histogram_without_values(spark):
    df = spark.createDataFrame([(None, "a")], "x double, s string")
    assert bins(df, "x") == [] and bins(df, "s") == [] and bins(df, "nope") == []


def test_histogram_rejects_infinity(spark):
    with pytest.raises(Exception, match="infinite"):
        bins(spark.createDataFrame([(1.0,), (float("inf"),)], "x double"), "x")


def test_histogram_has_no_join(spark, plan_of):
    plan = plan_of(histogram(spark.read.parquet(LINES), "l_tax"))
    assert "Join" not in plan and "ReadSchema: struct<l_tax:double>" in plan


# --- categories and groups -------------------------------------------------------------


def test_value_counts_sum_to_rows(spark):
    df = spark.read.parquet(LINES)
    found = stats.value_counts(df).groupBy("column").agg(F.sum("count").alias("n")).collect()
    assert {r["n"] for r in found} == {df.count()} and len(found) == 2


def test_value_counts_order_and_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,)], "s string")
    assert [(r["label"], r["count"]) for r in stats.value_counts(df).collect()] == [
        (None, 2), ("a", 1), ("b", 1),
    ]


def test_value_counts_plan(spark, plan_of):
    plan = plan_of(stats.label_counts(spark.read.parquet(LINES)))
    assert plan.count("Scan parquet") == 2 and plan.count("hashpartitioning") == 1


def test_top_categories_limit_before_the_last_shuffle(spark, plan_of):
    assert "WindowGroupLimit" in plan_of(stats.top_categories(spark.read.parquet(LINES)))


def test_long_labels_stay_out_of_the_counting_shuffle(spark, plan_of):
    docs = spark.read.parquet(LINES.replace("lineitem", "documents"))
    plan = plan_of(stats.counted_labels(docs, ["text", "lang"]))
    shuffled = re.search(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", plan).group(1)
    assert "head" in shuffled and "digest" in shuffled and "label" not in shuffled and "text" not in shuffled


@pytest.mark.parametrize("limit", [100_000, 0])
def test_top_categories_of_long_labels_that_tie(spark, monkeypatch, limit):
    monkeypatch.setattr(stats, "BROADCAST_LABELS", limit)
    same = "é" * 64
    labels = [same + x for x in "zyxwvuts"] + [same, same[:-1], None, "short", same + "many"] + [same + "many"] * 3 + [None] * 2
    df = spark.createDataFrame([(x, "k") for x in labels], "t string, s string")
    found = [tuple(r) for r in stats.top_categories(df, 6).orderBy("column", "position").collect()]
    counts = Counter(labels)
    order = sorted(counts, key=lambda x: (-counts[x], x is None, (x or "").encode()))
    assert found == [("s", 1, "k", len(labels))] + [("t", i, x, counts[x]) for i, x in enumerate(order[:6], 1)]



def test_group_aggregates(spark):
    df = spark.createDataFrame([("b", 1), ("a", None), (None, 3), ("a", None)], "k string, v int")

    def grouped(aggregation):
        return [tuple(r) for r in stats.group_aggregate(df, "k", "v", aggregation).collect()]

    assert grouped("sum") == grouped("anything") == [("a", 0.0), ("b", 1.0)]
    for aggregation in ("mean", "median", "min", "max"):
        assert grouped(aggregation) == [("a", None), ("b", 1.0)]
    assert grouped("count") == [("a", 0.0), ("b", 1.0)]


def test_sum_of_text_raises(spark):
    with pytest.raises(ValueError, match="numeric"):
        stats.group_aggregate(spark.createDataFrame([("a", "b")], "k string, v string"), "k", "v")


def test_timeline(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02 10:00:00' t union all select timestamp_ntz'2024-01-02 23:00:00' union all select null")
    assert [(str(r["label"]), r["value"]) for r in stats.timeline(df, "t").collect()] == [
        ("2024-01-02 00:00:00", 2)
    ]


# --- plans and edges of this round -------------------------------------------------------


@pytest.mark.parametrize("n", [8, 40, 100])
def test_correlation_reads_the_table_once_after_the_means(spark, monkeypatch, n):
    """Whatever the number of columns and gaps, one scan gives the sums of all pairs."""
    rng = random.Random(n)
    rows = [[rng.gauss(0, 1) if rng.random() > 0.2 else None for _ in range(n)] for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(n)))
    scans = []
    read = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: scans.append(1) or read(self, *a, **b))
    found = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.correlation(df).collect()}
    assert len(scans) == 1 and len(found) == n * n
    wanted = pd.DataFrame(rows, columns=[f"c{i}" for i in range(n)], dtype=float).corr()
    assert all(abs(found[a, b] - wanted.loc[a, b]) < 1e-9 for a in wanted for b in wanted)


def test_pair_that_is_constant_where_both_are_present(spark):
    rows = [(5.0, 1.0), (5.0, 2.0), (5.0, 3.0), (7.5, None), (9.25, None)]
    found = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.correlation(spark.createDataFrame(rows, "a double, b double")).collect()}
    assert found == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): None, ("b", "a"): None}


def test_hot_bucket_is_dealt_out_after_the_join(spark, monkeypatch, plan_of):
    """With many wanted buckets, an exchange stands between the join and the count per part."""
    monkeypatch.setattr(quantiles, "BROADCAST_BYTES", 0)
    rows = spark.range(4000).select(F.when(F.col("id") < 1600, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 7919 % 4001 / 10 + 1000).alias("v"))
    found = quantiles.grouped_quantiles(rows, ["k"], [0.5])
    plan = plan_of(found)
    assert "REPARTITION_BY_COL" in plan and "Join" in plan
    values = {r["k"]: r["q0"] for r in found.collect()}
    value = lambda i: i * 7919 % 4001 / 10 + 1000
    assert abs(values[0] - np.median([value(i) for i in range(1600)])) < 1e-9 and values[2000] == value(2000)


@pytest.mark.parametrize("values", [[-1.7e308, 1.7e308], [0.0, 5e-324]])
def test_range_that_cannot_be_cut_raises(spark, values):
    with pytest.raises(Exception, match="cannot be cut into bins"):
        histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
