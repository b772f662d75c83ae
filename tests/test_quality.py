from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheetwise.functions.columns import ROW_ID
from sheetwise.operators import profile as profiles
from sheetwise.operators.quality import dataset_summary, quality, recommendations
from sheetwise.operators.schema import classify

NAN = float("nan")


def test_missing_is_null_or_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, None), (None, "")], "x double, s string")
    rows = {r["column"]: r for r in profiles.profile(df).collect()}
    assert (rows["x"]["missing"], rows["x"]["missing_pct"]) == (2, 66.67)
    assert rows["s"]["missing"] == 1
    assert rows["s"]["data_bytes"] == 1


def test_missing_rows_are_equal(spark):
    df = spark.createDataFrame([(NAN,), (None,), (1.0,)], "x double")
    row = quality(df).first()
    assert (row["total_rows"], row["duplicated_rows"], row["total_missing_values"]) == (3, 1, 2)
    # 2 of 3 cells and 1 of 3 rows: 100 - 1.5 * 66.67 - 33.33 is below zero
    assert (row["quality_score"], row["band"]) == (0.0, "red")


def test_columns_do_not_mix(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, None)], "a int, b int")
    assert quality(df).first()["duplicated_rows"] == 1


def test_no_rows(spark):
    row = quality(spark.createDataFrame([], "a int")).first()
    assert row["empty_columns"] == ["a"] and row["quality_score"] == 100.0
    assert row["columns_with_missing_values"] == [] and row["has_problems"]


def test_long_texts_are_compared_whole(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",)], "s string")
    assert quality(df).first()["duplicated_rows"] == 1


def test_arrays_count_and_maps_raise(spark):
    arrays = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],), (None,)], "v array<double>")
    row = quality(arrays).first()
    assert (row["duplicated_rows"], row["total_missing_values"]) == (1, 1)
    with pytest.raises(ValueError, match="map columns"):
        quality(spark.createDataFrame([({"a": 1},)], "m map<string,int>"))


def test_recommendations_follow_problems(spark):
    clean = spark.createDataFrame([(1,), (2,)], "a int")
    assert [r["rule"] for r in recommendations(quality(clean)).collect()] == ["good_condition"]
    dirty = spark.createDataFrame([(1, None), (1, None)], "a int, b string")
    rules = [r["rule"] for r in recommendations(quality(dirty)).collect()]
    assert rules == ["remove_duplicates", "handle_missing", "columns_with_missing", "improve_quality"]


def test_summary_counts_classes(spark):
    df = spark.sql("select 1 a, true b, 'x' c, timestamp_ntz'2024-01-01' d, 1.5BD e")
    row = dataset_summary(df).first()
    assert (row["numeric_columns"], row["categorical_columns"]) == (2, 1)
    assert (row["datetime_columns"], row["boolean_columns"]) == (1, 1)
    assert classify(df, bool_as_numeric=True)["numeric"] == ["a", "b", "e"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, None)], "`a.b` int, `c``d` string")
    assert [r["column"] for r in profiles.profile(df).collect()] == ["a.b", "c`d"]
    assert quality(df).first()["columns_with_missing_values"] == ["c`d"]


def test_row_id_is_no_data(spark):
    df = spark.range(3).select("id", F.struct(F.lit("f").alias("file"), (3 - F.col("id")).alias("row")).alias(ROW_ID))
    assert quality(df).first()["total_columns"] == 1
    assert [r["id"] for r in profiles.first_rows(df, 2).collect()] == [2, 1]


def test_profile_is_one_scan(spark, plan_of):
    plan = plan_of(profiles.profile(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")))
    assert plan.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "Python" not in plan


def test_quality_is_one_scan(spark, plan_of):
    plan = plan_of(quality(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")))
    assert plan.count("Scan parquet") == 2
    assert plan.count("hashpartitioning") == 1


def test_wide_table_keeps_every_column(spark):
    names = [f"c{i}" for i in range(95)]
    df = spark.range(10).select(*[(F.col("id") + i).alias(n) for i, n in enumerate(names)])
    found = profiles.profile(df).orderBy("position").collect()
    assert [r["column"] for r in found] == names and {r["rows"] for r in found} == {10}
