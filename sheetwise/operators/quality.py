"""Data quality: missing cells, duplicate rows, score, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.columns import data_fields, row_key
from sheetwise.operators.schema import classify


def row_groups(df: DataFrame) -> DataFrame:
    """Distinct row keys k0, k1, … with the number of copies n.

    Copies are added up before the shuffle, so a row that fills a third of the table
    travels once per task.
    """
    keys = [row_key(f).alias(f"k{i}") for i, f in enumerate(data_fields(df))]
    return df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(
        F.count(F.lit(1)).alias("n")
    )


def row_counts(df: DataFrame) -> DataFrame:
    """One row: total_rows, distinct_rows, missing (an array with one count per column)."""
    missing = [
        F.coalesce(F.sum(F.when(F.col(f"k{i}").isNull(), F.col("n"))), F.lit(0))
        for i in range(len(data_fields(df)))
    ]
    return row_groups(df).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.array(*missing).alias("missing"),
    )


def quality(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """One row with totals, duplicate share, column lists, score, flags and band.

    One scan and one shuffle of row keys give the row count, the duplicates and the missing
    cells: a distinct row that occurs n times adds n to each column it lacks. Give ``counted`` if the rows
    have been counted already (`row_counts`).
    """
    names = [f.name for f in data_fields(df)]
    counted = row_counts(df) if counted is None else counted
    rows = F.greatest(F.col("total_rows"), F.lit(1))
    listed = [(F.col("missing")[i], F.lit(name)) for i, name in enumerate(names)]
    totals = counted.select(
        "total_rows",
        F.lit(len(names)).cast("bigint").alias("total_columns"),
        F.aggregate("missing", F.lit(0).cast("bigint"), lambda a, b: a + b).alias(
            "total_missing_values"
        ),
        (F.col("total_rows") - F.col("distinct_rows")).alias("duplicated_rows"),
        F.array_compact(F.array(*[F.when(m > 0, n) for m, n in listed])).alias(
            "columns_with_missing_values"
        ),
        F.array_compact(F.array(*[F.when(m == F.col("total_rows"), n) for m, n in listed])).alias(
            "empty_columns"
        ),
    )
    missing_pct = F.col("total_missing_values") / (rows * len(names)) * 100
    duplicated_pct = F.col("duplicated_rows") / rows * 100
    score = F.round(F.greatest(F.lit(0.0), 100 - missing_pct * 1.5 - duplicated_pct * 1.0), 1)
    return (
        totals.withColumns(
            {
                "missing_percentage": F.round(missing_pct, 2),
                "duplicated_percentage": F.round(duplicated_pct, 2),
                "quality_score": score,
                "has_missing_values": F.col("total_missing_values") > 0,
                "has_duplicates": F.col("duplicated_rows") > 0,
            }
        )
        .withColumn(
            "has_problems",
            F.col("has_duplicates")
            | F.col("has_missing_values")
            | (F.size("empty_columns") > 0),
        )
        .withColumn("band", band(F.col("quality_score")))
    )


def band(score):
    return F.when(score >= 90, "green").when(score >= 70, "yellow").otherwise("red")


def dataset_summary(df: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """One row: columns per class, flags and score."""
    found = classify(df)
    rated = quality(df) if rated is None else rated
    totals = [F.lit(len(found[kind])).alias(f"{kind}_columns") for kind in found]
    return rated.select(
        "total_columns", *totals, "has_missing_values", "has_duplicates", "quality_score"
    )


def recommendations(rated: DataFrame) -> DataFrame:
    """Rules that fire for a quality row: (rule, severity, message)."""

    def entry(rule, severity, message, fires):
        return F.struct(
            F.lit(rule).alias("rule"),
            F.lit(severity).alias("severity"),
            message.alias("message"),
            fires.alias("fires"),
        )

    problems = F.col("has_problems")
    rules = F.array(
        entry("good_condition", "ok",
              F.lit("The dataset is in good condition; no transformation is recommended."),
              ~problems),
        entry("remove_duplicates", "error",
              F.concat(F.col("duplicated_rows").cast("string"),
                       F.lit(" duplicated rows; consider removing them.")),
              problems & (F.col("duplicated_rows") > 0)),
        entry("handle_missing", "warning",
              F.concat(F.col("total_missing_values").cast("string"),
                       F.lit(" missing values; consider dropping or filling them.")),
              problems & (F.col("total_missing_values") > 0)),
        entry("columns_with_missing", "info",
              F.concat(F.lit("Columns with missing values: "),
                       F.array_join("columns_with_missing_values", ", ")),
              problems & (F.size("columns_with_missing_values") > 0)),
        entry("improve_quality", "warning",
              F.concat(F.lit("The quality can improve; current score "),
                       F.col("quality_score").cast("string"), F.lit("/100.")),
              problems & (F.col("quality_score") < 90)),
    )
    return rated.select(F.inline(F.filter(rules, lambda r: r["fires"]))).drop("fires")
