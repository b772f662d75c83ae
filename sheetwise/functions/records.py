"""Rows as JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions.columns import data_fields, present


def iso_text(value: Column) -> Column:
    """ISO 8601 text of a timestamp; the fraction is written only when there is one."""
    seconds = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(value, ".SSSSSS")
    return F.when(fraction == ".000000", seconds).otherwise(F.concat(seconds, fraction))


def record_value(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(present(field))
    if isinstance(field.dataType, T.DateType):
        return iso_text(present(field).cast("timestamp_ntz"))
    return present(field)


def record(df: DataFrame) -> Column:
    """JSON text of the row: missing as null, timestamps as ISO text."""
    values = [record_value(f).alias(f.name) for f in data_fields(df)]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
