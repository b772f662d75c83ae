"""Per-column profile and first rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions.columns import ROW_ID, chunks, col, data_fields, is_text, present
from sheetwise.operators.schema import column_class

# Fixed widths in bytes of the types with a constant size.
WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}

#: Columns per aggregate; more would pass the field limit of whole-stage codegen.
COLUMNS_PER_AGGREGATE = 40


def _width(dtype: T.DataType) -> int | None:
    if isinstance(dtype, T.DecimalType):
        return 8 if dtype.precision <= 18 else 16
    return WIDTHS.get(type(dtype))


def data_bytes(field: T.StructField) -> Column:
    """Aggregate: estimated data bytes of a column. Fixed widths follow from the count."""
    value, width = col(field.name), _width(field.dataType)
    if width is not None:
        return F.count(present(field)) * width
    if is_text(field.dataType) or isinstance(field.dataType, T.BinaryType):
        size = F.octet_length(value)
    elif isinstance(field.dataType, T.ArrayType) and _width(field.dataType.elementType):
        size = F.when(value.isNotNull(), F.size(value) * _width(field.dataType.elementType))
    else:
        size = F.octet_length(F.to_json(F.struct(value)))
    return F.coalesce(F.sum(size.cast("bigint")), F.lit(0).cast("bigint"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, column, type, class, rows, missing, missing_pct, data_bytes.

    Each column is read once. The aggregates are global, so a task sends on one row.
    """
    fields = data_fields(df)
    parts = []
    for part in chunks(list(enumerate(fields)), COLUMNS_PER_AGGREGATE):
        rows = F.count(F.lit(1))
        entries = []
        for position, field in part:
            entries.append(
                F.struct(
                    F.lit(position).alias("position"),
                    F.lit(field.name).alias("column"),
                    F.lit(field.dataType.simpleString()).alias("type"),
                    F.lit(column_class(field.dataType)).alias("class"),
                    rows.alias("rows"),
                    (rows - F.count(present(field))).alias("missing"),
                    data_bytes(field).alias("data_bytes"),
                )
            )
        parts.append(df.agg(F.array(*entries).alias("entries")).select(F.inline("entries")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    share = F.col("missing") / F.greatest(F.col("rows"), F.lit(1)) * 100
    return merged.select(
        "position", "column", "type", "class", "rows", "missing",
        F.round(share, 2).alias("missing_pct"), "data_bytes",
    )


def dataset_size(profiled: DataFrame) -> DataFrame:
    """One row: total rows, total columns, estimated data bytes."""
    return profiled.agg(
        F.max("rows").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.sum("data_bytes").alias("data_bytes"),
    )


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows in file order when the table has row ids (`read_table(..., row_id=True)`),
    else any n rows."""
    if ROW_ID not in df.columns:
        return df.limit(n)
    return _first_files(df, n).orderBy(ROW_ID).limit(n).drop(ROW_ID)


def _first_files(df: DataFrame, n: int) -> DataFrame:
    """The table cut to its first files, as many as hold n rows.

    One comparison of the file name prunes the scan; the number of files grows in three steps, and
    the whole table is the last resort.
    """
    files = sorted(re.sub("^file:/+", "file:/", name) for name in df.inputFiles())
    for take in (1, 32, 1024):
        if take >= len(files):
            break
        head = df.filter(F.col(ROW_ID)["file"] <= files[take - 1])
        if head.limit(n).count() == n:
            return head
    return df
