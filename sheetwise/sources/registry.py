"""Data set registry: a listing of a folder of tables."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.sources.csv_records import record_counts


def _data_set(path: Column, folder: str) -> Column:
    """Path of the data set that a file belongs to: the file or folder right below ``folder``."""
    inside = f"{urlparse(folder).path.rstrip('/')}/"
    start = F.locate(inside, path) + len(inside)
    return F.concat(F.substr(path, F.lit(1), start - 1), F.regexp_extract(F.substr(path, start), "^[^/]+", 0))


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """(name, original_filename, file_path, file_size, file_type, created_at) per data set.

    A data set is a file in the folder, or a folder in it with part files. Only the listing
    is read, not the contents.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    sets = (
        listed.select("length", "modificationTime", _data_set(F.col("path"), folder).alias("file_path"))
        .groupBy("file_path")
        .agg(F.sum("length").alias("file_size"), F.max("modificationTime").alias("created_at"))
        .withColumn("file", F.regexp_extract("file_path", "[^/]+$", 0))
    )
    return sets.select(
        F.regexp_replace("file", r"\.[^.]+$", "").alias("name"),
        F.col("file").alias("original_filename"),
        "file_path",
        "file_size",
        F.lower(F.regexp_extract("file", r"(\.[^.]+)$", 1)).alias("file_type"),
        "created_at",
    )


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, total_rows) of all Parquet and CSV data sets in a folder, in one plan whatever their number.

    No column of a Parquet file is read, only the row counts in its footer; records of CSV files are
    framed but not parsed, and their headers are not counted.
    """
    nested = {"recursiveFileLookup": "true"}
    parquet = spark.read.options(**nested, pathGlobFilter="*.parquet").schema("no_column boolean").parquet(folder)
    rows = parquet.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("total_rows"))
    csv = record_counts(spark, folder, **nested, pathGlobFilter="*.csv")
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # the listing has paths as they are written
    counted = rows.unionByName(csv).groupBy(_data_set(path, folder).alias("file_path"))
    return counted.agg(F.sum("total_rows").alias("total_rows"))


def recent(registry: DataFrame, limit: int = 50) -> DataFrame:
    """Newest data sets first."""
    return registry.orderBy(F.desc("created_at"), "file_path").limit(limit)


def by_name(registry: DataFrame, name: str) -> DataFrame:
    return registry.filter(F.col("name") == name)


def by_path(registry: DataFrame, path: str) -> DataFrame:
    """The one data set at a path; the path is its identity."""
    return registry.filter(F.col("file_path") == path)


def first_match(table: DataFrame, column: str, value, key: str) -> DataFrame:
    """First row by ``key`` whose column equals the value, e.g. a user by e-mail."""
    return table.filter(F.col(column) == F.lit(value)).orderBy(key).limit(1)
