from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import table

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def test_search_is_a_regex_over_text(spark):
    df = spark.createDataFrame([("a.b", 1), ("axb", 2), ("c", 3), (None, 4), ("Ñu", 5)], "s string, n int")
    assert [r["n"] for r in table.search(df, "A.B").collect()] == [1, 2]
    assert [r["n"] for r in table.search(df, "ñ").collect()] == [5]
    assert table.search(df, "").count() == 5
    assert table.search(df, "1").count() == 0
    assert table.search(df.select("n"), "1").count() == 0
    with pytest.raises(Exception, match="Unclosed group"):
        table.search(df, "(").collect()


def test_sort_puts_missing_last(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),)], "x double")
    rows = table.sort_rows(df, "x", "desc").select(F.nanvl("x", F.lit(None))).collect()
    assert [r[0] for r in rows] == [3.0, 1.0, None, None]
    rows = table.sort_rows(df, "x", "other").select(F.nanvl("x", F.lit(None))).collect()
    assert [r[0] for r in rows] == [1.0, 3.0, None, None]
    assert table.sort_rows(df, "unknown").count() == 4


def test_pages_make_up_the_table(spark, plan_of):
    df = spark.read.parquet(ORDERS)
    wanted = [tuple(r) for r in table.sort_rows(df, "o_orderdate", "desc").collect()]
    pages, last = [], None
    for number in range(1, 4):
        rows = table.page(df, number, 100, "o_orderdate", "desc").collect()
        if last is not None:
            after = table.page_after(df, last.asDict(), 100, "o_orderdate", "desc").collect()
            assert after == rows
        pages += rows
        last = rows[-1]
    assert [tuple(r) for r in pages] == wanted[:300]
    assert "TakeOrderedAndProject" in plan_of(table.page(df, 2, 10, "o_orderdate"))


def test_page_after_missing_values(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i // 4) for i in range(40)], "i int, v int")
    for direction in ("asc", "desc"):
        wanted = table.sort_rows(df, "v", direction).collect()
        got = table.page(df, 1, 7, "v", direction).collect()
        while len(got) < len(wanted):
            got += table.page_after(df, got[-1].asDict(), 7, "v", direction).collect()
        assert got == wanted


def test_page_after_does_not_depend_on_the_time_zone(spark):
    df = spark.read.parquet(ORDERS)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        first, second = (table.page(df, n, 9, "o_orderdate").collect() for n in (1, 2))
        after = table.page_after(df, first[-1].asDict(), 9, "o_orderdate").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert after == second


def test_deep_pages_equal_sorted_rows(spark, monkeypatch):
    monkeypatch.setattr(table, "NEAR_ROWS", 5)
    df = spark.read.parquet(ORDERS).withColumn("g", F.col("o_orderkey") % 3)
    wanted = [tuple(r) for r in table.sort_rows(df, "g").collect()]
    for number, size in ((1, 50), (7, 100), (2, 1000), (40, 37), (99, 100)):
        rows = table.page(df, number, size, "g").collect()
        assert [tuple(r) for r in rows] == wanted[(number - 1) * size : number * size]


def test_deep_page_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(table, "NEAR_ROWS", 5)
    df = spark.range(0, 3000, 1, 8).select(F.when(F.col("id") < 1000, F.col("id")).otherwise(-1).alias("x"))
    found = [r["x"] for r in table.page(df, 20, 100, "x").collect()]
    assert found == [-1] * 100
    found = [r["x"] for r in table.page(df, 21, 100, "x").collect()]
    assert found == list(range(100))


def test_pages_of_a_table_with_maps_partition_the_rows(spark, monkeypatch):
    monkeypatch.setattr(table, "NEAR_ROWS", 50)
    monkeypatch.setattr(table, "SAMPLE", 400)
    nested = F.array(F.create_map(F.col("id") % 4, F.struct(F.create_map(F.lit("x"), F.col("id") % 3))))
    df = spark.range(0, 6000, 1, 8).select(
        F.lit(1).alias("same"),
        F.when(F.col("id") % 50 != 0, F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(F.col("id"), F.col("id") % 5))).alias("m"),
        nested.alias("nested"),
    )
    df = df.unionAll(df.limit(0)).unionAll(spark.range(0, 300, 1, 3).select(F.lit(1), F.create_map(F.lit("a"), F.lit(0).cast("bigint")), F.array()))
    form = lambda r: (tuple(sorted((r["m"] or {"none": 0}).items())), repr(r["nested"]))
    wanted = [form(r) for r in table.sort_rows(df, "same").collect()]
    found = []
    for number in (1, 2, 15, 16, 17, 40, 62, 63, 64):
        rows = [form(r) for r in table.page(df, number, 100, "same").collect()]
        assert rows == wanted[(number - 1) * 100 : number * 100]
        found += rows
    assert len(found) == 800 and len(set(found)) > 400
    last = table.page(df, 16, 100, "same").collect()[-1]
    after = table.page_after(df, last.asDict(), 100, "same").collect()
    assert [form(r) for r in after] == wanted[1600:1700]


def test_page_behind_the_end_is_empty(spark):
    assert table.page(spark.range(5000), 100, 100).count() == table.page(spark.range(9000), 100, 100).count() == 0
    assert table.page(spark.range(5000), 51, 100, "id").count() == 0
    assert table.page(spark.range(5000), 50, 100, "id", total_rows=5000).count() == 100


def test_deep_page_takes_few_jobs(spark):
    df = spark.range(0, 400_000, 1, 8).select((F.col("id") * 7919 % 400_000).alias("x"))
    group = "deep page"
    spark.sparkContext.setJobGroup(group, group)
    found = [r["x"] for r in table.page(df, 3001, 100, "x").collect()]
    assert found == list(range(300_000, 300_100))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 8
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("page, size", [(0, 10), (1, 0)])
def test_bad_page(spark, page, size):
    with pytest.raises(ValueError):
        table.page(spark.range(1), page, size)
    with pytest.raises(ValueError):
        table.page_info(spark.range(1), "", page, size)


def test_page_info(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    row = table.page_info(df, "a|b", 1, 2).first()
    assert (row["total_rows"], row["filtered_rows"], row["total_pages"]) == (3, 2, 1)
    assert table.page_info(df, "z").first()["total_pages"] == 1


def test_records(spark):
    df = spark.createDataFrame(
        [(1, datetime(2024, 1, 2, 3, 4, 5), None, float("nan"), True), (2, datetime(2024, 1, 2, 3, 4, 5, 60), "x\"", 0.5, None)],
        "i int, t timestamp_ntz, s string, d double, b boolean",
    )
    assert [json.loads(r["record"]) for r in table.records(df).collect()] == [
        {"i": 1, "t": "2024-01-02T03:04:05", "s": None, "d": None, "b": True},
        {"i": 2, "t": "2024-01-02T03:04:05.000060", "s": "x\"", "d": 0.5, "b": None},
    ]
