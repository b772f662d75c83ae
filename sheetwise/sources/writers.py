"""Writing tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetwise.functions.columns import ROW_ID, col
from sheetwise.sources.readers import suffix_of

TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def write_table(df: DataFrame, path: str, replace: bool = False) -> str:
    """Write a folder of part files; the suffix (.csv, .parquet) chooses the format. An existing
    folder raises unless it is to be replaced."""
    writers = {".csv": write_csv, ".parquet": write_parquet}
    suffix = suffix_of(path)
    if suffix not in writers:
        raise ValueError(f"Unsupported export format: {suffix}")
    return writers[suffix](df, path, "overwrite" if replace else "error")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    """CSV with a header line per part file, no index column, missing as an empty cell."""
    values = [
        col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, TIMES) else col(f.name)
        for f in df.schema.fields
        if f.name != ROW_ID
    ]
    options = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*values).write.mode(mode).csv(path, header=True, escape='"', **options)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> str:
    df.drop(ROW_ID).write.mode(mode).parquet(path)
    return path


def clean_path(path: str) -> str:
    """``<stem>_clean<suffix>`` next to the original."""
    original = PurePosixPath(path)
    folder = path[: len(path.rstrip("/")) - len(original.name)]
    return f"{folder}{original.stem}_clean{original.suffix}"
