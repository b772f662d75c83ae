"""Ordered cleaning steps: run, preview, run and save."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators import cleaning
from sheetwise.sources.readers import suffix_of
from sheetwise.sources.writers import clean_path, write_table

# Operation names and the parameter that each takes.
OPERATIONS = {
    "remove_duplicates": (cleaning.remove_duplicates, None, None),
    "remove_missing_values": (cleaning.remove_missing_values, None, None),
    "convert_column_types": (cleaning.convert_column_types, "column_types", {}),
    "normalize_text": (cleaning.normalize_text, "columns", []),
    "rename_columns": (cleaning.rename_columns, "column_mapping", {}),
    "filter_rows": (cleaning.filter_rows, "query", ""),
}


def apply_steps(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply steps {operation, params} in order, as one plan. An unknown operation raises."""
    for step in steps:
        name = step.get("operation", "")
        if name not in OPERATIONS:
            raise ValueError(f"Unknown operation: {name!r}")
        operation, parameter, default = OPERATIONS[name]
        params = step.get("params") or {}
        df = operation(df, params.get(parameter, default)) if parameter else operation(df)
    return df


def preview_steps(df: DataFrame, steps: list[dict]) -> DataFrame:
    """One row: original_rows, resulting_rows, removed_rows, operations. Nothing is written.

    Both counts are scalar subqueries, each over its own pruned plan: the original count
    reads no columns of a Parquet table.
    """
    rows = F.count(F.lit(1)).alias("rows")
    counts = df.sparkSession.range(1).select(
        df.agg(rows).scalar().alias("original_rows"),
        apply_steps(df, steps).agg(rows).scalar().alias("resulting_rows"),
    )
    operations = F.array(*[F.lit(step["operation"]) for step in steps]).cast("array<string>")
    return counts.select(
        "original_rows",
        "resulting_rows",
        (F.col("original_rows") - F.col("resulting_rows")).alias("removed_rows"),
        operations.alias("operations"),
    )


def run_steps(df: DataFrame, steps: list[dict], source_path: str) -> tuple[str, DataFrame]:
    """Write the cleaned copy to ``<stem>_clean<suffix>`` and report on it.

    Returns the new path and one row: original_rows, resulting_rows, resulting_columns,
    message. The source stays as it is; the copy of an earlier run is replaced,
    which raises if the rows to clean are read from it. The result is counted from the files written, not by
    counters inside the write job: a stage that is run again after an executor is lost would
    count its rows twice.
    """
    spark = df.sparkSession
    cleaned = apply_steps(df, steps)
    path = clean_path(source_path)
    folder = unquote(urlparse(path).path).rstrip("/")
    if any(unquote(urlparse(file).path).startswith(f"{folder}/") for file in df.inputFiles()):
        raise ValueError(f"Cannot overwrite {path}: the rows to clean are read from it")
    write_table(cleaned, path, replace=True)
    if suffix_of(path) == ".csv":
        columns = ", ".join(f"`{name}` string" for name in cleaned.columns)
        written = spark.read.csv(path, schema=columns, header=True, escape='"', multiLine=True)
    else:
        written = spark.read.parquet(path)
    rows = F.count(F.lit(1)).alias("rows")
    counts = spark.range(1).select(
        df.agg(rows).scalar().alias("original_rows"),
        written.agg(rows).scalar().alias("resulting_rows"),
        F.lit(len(cleaned.columns)).alias("resulting_columns"),
    )
    message = F.concat(
        F.lit("Cleaning finished. "), F.col("original_rows").cast("string"),
        F.lit(" -> "), F.col("resulting_rows").cast("string"), F.lit(" rows."),
    )
    return path, counts.withColumn("message", message)
