"""Column classes, read from the schema alone (no job)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetwise.functions.columns import data_fields, is_text

CLASSES = ("numeric", "categorical", "datetime", "boolean")


def column_class(dtype: T.DataType, bool_as_numeric: bool = False) -> str:
    if isinstance(dtype, T.BooleanType):
        return "numeric" if bool_as_numeric else "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "categorical" if is_text(dtype) else "other"


def classify(df: DataFrame, bool_as_numeric: bool = False) -> dict[str, list[str]]:
    """Column names per class, in schema order.

    Arrays, structs and binary fall in no class: they are profiled for type and missing
    values only.
    """
    found: dict[str, list[str]] = {name: [] for name in CLASSES}
    for field in data_fields(df):
        kind = column_class(field.dataType, bool_as_numeric)
        if kind in found:
            found[kind].append(field.name)
    return found


def column_classes(df: DataFrame, bool_as_numeric: bool = False) -> DataFrame:
    """One row per class: (class, total, columns)."""
    found = classify(df, bool_as_numeric)
    rows = [(kind, len(names), names) for kind, names in found.items()]
    return df.sparkSession.createDataFrame(rows, "class string, total int, columns array<string>")


def fields_of(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]
