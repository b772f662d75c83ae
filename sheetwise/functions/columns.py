"""Column references, missing values and row keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File position column that `read_table(..., row_id=True)` adds.
ROW_ID = "_row_id"


def col(name: str) -> Column:
    """Column by exact name; dots and back-quotes in names are not special."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_fields(df: DataFrame) -> list[T.StructField]:
    """Fields of the data set, without the file position column."""
    return [f for f in df.schema.fields if f.name != ROW_ID]


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def present(field: T.StructField) -> Column:
    """The value, with float NaN turned into NULL so that missing has one form."""
    value = col(field.name)
    return F.when(~F.isnan(value), value) if is_float(field.dataType) else value


def as_double(field: T.StructField) -> Column:
    """Numeric or boolean column as a double, missing as NULL."""
    value = present(field)
    if isinstance(field.dataType, T.BooleanType):
        value = value.cast("int")
    return value.cast("double")


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def row_key(field: T.StructField) -> Column:
    """Value to compare whole rows by.

    Text is replaced by its SHA-256 digest, whatever its length, so a shuffle of row keys stays
    narrow. Rows with equal keys are equal rows, as `remove_duplicates` takes them.
    """
    if isinstance(field.dataType, T.MapType):
        raise ValueError(f"Column {field.name!r}: map columns cannot be compared for duplicates")
    value = present(field)
    return F.unhex(F.sha2(value, 256)) if is_text(field.dataType) else value


def _unordered(dtype: T.DataType) -> bool:
    """Whether Spark cannot sort by the type."""
    if isinstance(dtype, T.ArrayType):
        return _unordered(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_unordered(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType, T.CalendarIntervalType))


def sortable(value: Column, dtype: T.DataType) -> Column:
    """The value in a form that sorts: maps, at any depth, as their entries in order of the keys.

    Two values have the same form only if they are equal (maps: whatever the order of their entries).
    """
    if not _unordered(dtype):
        return value
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: sortable(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        parts = [sortable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.MapType):
        entry = lambda e: F.struct(
            sortable(e["key"], dtype.keyType).alias("key"), sortable(e["value"], dtype.valueType).alias("value")
        )
        return F.array_sort(F.transform(F.map_entries(value), entry))
    return F.to_json(value) if isinstance(dtype, T.VariantType) else value.cast("string")


def chunks(items: list, size: int) -> Iterable[list]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def name_of(position: Column, names: list[str]) -> Column:
    """Column name for a 0-based position."""
    return F.get(F.array(*[F.lit(n) for n in names]), position)
