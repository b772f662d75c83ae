"""Stored intermediate tables, row identity and text helpers of the operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends, the size is known to the planner.

    Files in the shared folder outlive any executor, and a join broadcasts the table only if
    its measured size is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Add struct column ``name``, unique per row and the same in every job.

    Rows of files are known by file and position; other rows are written out first.
    """
    try:
        return df.select(
            "*",
            F.struct(
                F.xxhash64("_metadata.file_path").alias("file"),
                F.col("_metadata.row_index").alias("row"),
            ).alias(name),
        )
    except AnalysisException:
        numbered = F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("row"))
        return stored(df.select("*", numbered.alias(name)), "rows")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
