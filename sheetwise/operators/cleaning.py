"""Cleaning operators: duplicates, missing rows, types, text, names, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.columns import ROW_ID, col, data_fields, is_float, is_text, present
from sheetwise.functions.text import strip, title_case

# Names of target types and their Spark types.
TYPE_NAMES = {
    "int": "bigint", "int64": "bigint", "Int64": "bigint", "int32": "int", "Int32": "int",
    "int16": "smallint", "int8": "tinyint", "float": "double", "float64": "double",
    "Float64": "double", "float32": "float", "bool": "boolean", "boolean": "boolean",
    "str": "string", "string": "string", "object": "string", "category": "string",
    "datetime64[ns]": "timestamp_ntz",
}


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows, the first where rows have a position; missing equals
    missing."""
    names = [f.name for f in data_fields(df)]
    floats = {f.name: present(f) for f in data_fields(df) if is_float(f.dataType)}
    rows = _replace(df, floats)
    if ROW_ID not in df.columns:
        return rows.dropDuplicates(names)
    # equal rows differ in their position only
    kept = rows.groupBy(*[col(n) for n in names]).agg(F.min(ROW_ID).alias(ROW_ID))
    return kept.select(*[col(n) for n in df.columns])


def remove_missing_values(df: DataFrame) -> DataFrame:
    """Drop a row if any column is missing (NULL or NaN)."""
    keep = F.lit(True)
    for field in data_fields(df):
        keep = keep & present(field).isNotNull()
    return df.filter(keep)


def convert_column_types(df: DataFrame, column_types: dict[str, str]) -> DataFrame:
    """Cast columns; unknown columns are skipped, a value that does not fit raises.

    Missing stays NULL for every target type.
    """
    casts = {
        name: present(df.schema[name]).cast(TYPE_NAMES.get(target, target))
        for name, target in column_types.items()
        if name in df.columns
    }
    return _replace(df, casts)


def normalize_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strip blanks and set title case; unknown columns are skipped."""
    cleaned = {
        name: title_case(strip(present(df.schema[name]).cast("string")))
        for name in columns
        if name in df.columns
    }
    return _replace(df, cleaned)


def rename_columns(df: DataFrame, column_mapping: dict[str, str]) -> DataFrame:
    """Rename columns; unknown names are ignored."""
    return df.select(
        *[col(name).alias(column_mapping.get(name, name)) for name in df.columns]
    )


def filter_rows(df: DataFrame, query: str | Column) -> DataFrame:
    """Keep rows that fulfil a Spark SQL predicate.

    SQL drops rows where the predicate is unknown: write ``not (a <=> 5)`` to keep rows
    whose ``a`` is missing.
    """
    if isinstance(query, str) and not query.strip():
        raise ValueError("filter_rows needs a predicate")
    return df.filter(query)


def _replace(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(
        *[values[name].alias(name) if name in values else col(name) for name in df.columns]
    )


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in data_fields(df) if is_text(f.dataType)]
