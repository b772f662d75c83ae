"""Counts of the shared pass against the operators that make their own, and the number of scans."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import quality as qualities
from sheetwise.operators import stats
from sheetwise.operators.profile import profile
from sheetwise.plans import analysis
from sheetwise.plans.shared_pass import count_all

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def odd(spark):
    nan, at = float("nan"), datetime.datetime(1969, 12, 31, 23, 59, 59, 1)
    rows = [
        ("a" * 100, 1, 0.0, at, True, [1.0], None), ("a" * 100, 1, -0.0, at, True, [1.0], None), ("", None, nan, None, None, None, None),
        (None, 3, None, at + datetime.timedelta(microseconds=1), False, [], None), ("b", 3, 1e300, at, False, [2.0], None),
        ("b", 3, 1e300, at, False, [2.0], None), ("null", 5, -7.5, datetime.datetime(2024, 5, 1), None, None, None),
    ]
    return spark.createDataFrame(rows, "t string, i int, d double, at timestamp_ntz, f boolean, l array<double>, none string")


def listed(df):
    return sorted(map(repr, df.collect()))


def test_counts_equal_the_single_operators(spark, odd):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    for df in (odd, orders, orders.limit(0), spark.read.parquet(f"{SF}/events.parquet")):
        counts = count_all(df)
        assert listed(counts.value_counts()) == listed(stats.value_counts(df))
        assert listed(stats.numeric_stats(df, counted=counts.buckets())) == listed(stats.numeric_stats(df))
        assert listed(counts.datetime_stats()) == listed(stats.datetime_stats(df))
        assert listed(qualities.quality(df, counts.rows())) == listed(qualities.quality(df))
        rounded = lambda pairs: listed(pairs.withColumn("corr", F.round("corr", 9)))
        assert rounded(stats.correlation(df, centres=counts.centres())) == rounded(stats.correlation(df))
        short = count_all(df, whole_labels=False, duplicates=False, bool_as_numeric=True)
        assert listed(stats.top_categories(df, 2, counted=short.labels())) == listed(stats.top_categories(df, 2))
        assert listed(stats.context_stats(df, counted=short.buckets())) == listed(stats.context_stats(df))
        assert listed(short.missing()) == listed(profile(df).select("position", "column", "missing", "missing_pct"))


def test_time_zone_does_not_matter(spark, odd):
    zone = spark.conf.get("spark.sql.session.timeZone")
    wanted = listed(count_all(odd).datetime_stats())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert listed(count_all(odd).datetime_stats()) == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_maps_are_refused(spark):
    with pytest.raises(ValueError, match="map columns"):
        count_all(spark.range(1).select(F.create_map("id", "id").alias("m")))


def counting(spark, df):
    """The table, and a counter of rows read from it."""
    read = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(pass_on, df.schema), read


def test_analysis_and_context_take_three_scans(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumn("twice", F.col("o_totalprice") * 2).drop("o_comment")
    rows = orders.count()
    df, read = counting(spark, orders)
    for part in analysis.analyze(df).values():
        part.collect()
    assert read.value <= 3 * rows
    df, read = counting(spark, orders)
    analysis.context_json(df, orders.limit(20)).collect()
    assert read.value <= 3 * rows
