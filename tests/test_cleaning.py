from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sheetwise.functions.columns import ROW_ID
from sheetwise.operators import cleaning
from sheetwise.plans import cleaning_run
from sheetwise.session import scratch_path
from sheetwise.sources.readers import read_table
from sheetwise.sources.writers import clean_path, write_table


def values(df, name):
    return [r[name] for r in df.collect()]


def test_title_case(spark):
    df = spark.createDataFrame(
        [("  o'NEIL-smith abc123def\t",), ("ÁRBOL ñu",), ("\u00a0 x \n",), (None,), ("",)], "s string"
    )
    assert values(cleaning.normalize_text(df, ["s", "nope"]), "s") == [
        "O'Neil-Smith Abc123Def", "Árbol Ñu", "X", None, "",
    ]


def test_convert_truncates_and_keeps_missing(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,), (None,), (float("nan"),)], "x double")
    assert values(cleaning.convert_column_types(df, {"x": "int64"}), "x") == [1, -1, None, None]


def test_convert_bad_text_raises(spark):
    df = spark.createDataFrame([("x",)], "x string")
    with pytest.raises(PySparkException):
        cleaning.convert_column_types(df, {"x": "int64"}).collect()


def test_drop_missing_sees_nan(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3), (2.0, None)], "x double, y int")
    assert values(cleaning.remove_missing_values(df), "x") == [1.0]


def test_missing_rows_are_duplicates(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 1), (0.0, 1), (-0.0, 1)], "x double, y int")
    assert sorted(values(cleaning.remove_duplicates(df), "x"), key=str) == [0.0, None]


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "x int, s string")
    for operation in (cleaning.remove_duplicates, cleaning.remove_missing_values):
        once = operation(df)
        assert sorted(once.collect(), key=str) == sorted(operation(once).collect(), key=str)


def test_rename_swaps_and_ignores_unknown(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert cleaning.rename_columns(df, {"a": "b", "b": "a", "z": "y"}).columns == ["b", "a"]


def test_filter_and_missing(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "a int")
    assert cleaning.filter_rows(df, "not (a <=> 5)").count() == 2
    assert cleaning.filter_rows(df, "a <> 5").count() == 1
    with pytest.raises(ValueError):
        cleaning.filter_rows(df, " ")


def test_filter_reaches_the_scan(spark, plan_of):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    steps = [
        {"operation": "filter_rows", "params": {"query": "c_acctbal > 10"}},
        {"operation": "rename_columns", "params": {"column_mapping": {"c_name": "name"}}},
    ]
    plan = plan_of(cleaning_run.apply_steps(df, steps).select("name"))
    assert "GreaterThan(c_acctbal,10.0)" in plan
    assert "ReadSchema: struct<c_name:string,c_acctbal:double>" in plan


def test_unknown_operation_raises(spark):
    with pytest.raises(ValueError, match="Unknown operation"):
        cleaning_run.apply_steps(spark.range(1), [{"operation": "explode"}])


def test_missing_params_do_nothing(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    steps = [{"operation": o} for o in ("convert_column_types", "normalize_text", "rename_columns")]
    assert cleaning_run.apply_steps(df, steps).collect() == df.collect()


def test_preview_counts(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    steps = [{"operation": "remove_duplicates"}, {"operation": "remove_missing_values"}]
    row = cleaning_run.preview_steps(df, steps).first()
    assert row.asDict() == {
        "original_rows": 3, "resulting_rows": 1, "removed_rows": 2,
        "operations": ["remove_duplicates", "remove_missing_values"],
    }
    assert cleaning_run.preview_steps(df, []).first()["operations"] == []


@pytest.mark.parametrize("suffix", [".csv", ".parquet"])
def test_run_writes_a_clean_copy(spark, suffix):
    source = scratch_path(spark, f"people{suffix}")
    df = spark.createDataFrame([("Alice", 25), ("Bob, \"B\"\nline", 30), ("Alice", 25)], "name string, age bigint")
    write_table(df, source)
    path, report = cleaning_run.run_steps(df, [{"operation": "remove_duplicates"}], source)
    assert path == source.replace("people", "people_clean")
    row = report.first()
    assert (row["original_rows"], row["resulting_rows"], row["resulting_columns"]) == (3, 2, 2)
    options = {"multi_line": True} if suffix == ".csv" else {}
    again = read_table(spark, path, **options)
    assert sorted(map(tuple, again.collect())) == [("Alice", 25), ("Bob, \"B\"\nline", 30)]
    assert read_table(spark, source, **options).count() == 3


def test_clean_path():
    assert clean_path("/data/up/a.b.csv") == "/data/up/a.b_clean.csv"
    assert clean_path("s3a://bucket/x.parquet/") == "s3a://bucket/x_clean.parquet"


def test_first_of_equal_rows_is_kept(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 4000, 1, 4).selectExpr("id % 10 AS a", "'x' AS s", "if(id % 2 = 0, double('NaN'), null) AS f").write.parquet(path)
    rows = read_table(spark, path, row_id=True)
    kept = cleaning.remove_duplicates(rows)
    first = rows.groupBy("a").agg(F.min(ROW_ID).alias("first"))
    assert kept.columns == rows.columns and kept.count() == 10
    assert kept.join(first, "a").filter(F.col(ROW_ID) != F.col("first")).isEmpty()
