"""One pass over a table for everything that is counted in it.

Each row gives one tagged key per cell and one for itself: labels, logarithmic buckets of numbers, dates, and the
row's digest with its missing columns. One grouping counts all of them, combined inside each task first. A
second one reduces dates to their range and rows to the number of equal and different ones, so that only labels
and buckets are kept. Statistics, quality and top labels are then read off the kept counts; only the quantiles and the
correlation look at the table again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.columns import as_double, col, data_fields, name_of, present, row_key
from sheetwise.operators.quantiles import log_bucket
from sheetwise.operators.schema import classify, fields_of
from sheetwise.operators.stats import label_key
from sheetwise.session import shared_folder

LABEL, NUMBER, DATE, ROW = range(4)
KEY = ["part", "c", "s", "d", "b"]
#: Writes a row so that two rows have the same text only if they are equal.
EXACT = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _key(part: int, c: int, s=None, d=None, b=None, v=None) -> Column:
    """A tagged key: part, column number, text, digest, whole number; and the value that is summed up."""
    kinds = {"part": "tinyint", "c": "int", "s": "string", "d": "binary", "b": "bigint", "v": "double"}
    values = [F.lit(part), F.lit(c), *[F.lit(None) if x is None else x for x in (s, d, b, v)]]
    return F.struct(*[x.cast(t).alias(n) for x, (n, t) in zip(values, kinds.items(), strict=True)])


def _row_digest(df: DataFrame) -> Column:
    for field in data_fields(df):
        row_key(field)  # raises for columns that cannot be compared
    values = []
    for field in data_fields(df):
        value = present(field)
        # zero has one sign
        values.append((value + 0.0 if field.dataType.typeName() in ("double", "float") else value).alias(field.name))
    return F.unhex(F.sha2(F.to_json(F.struct(*values), EXACT), 256))


@dataclass
class Counts:
    """What one pass has counted."""

    kept: DataFrame
    columns: dict[str, list[str]]
    names: list[str]

    def _part(self, part: int) -> DataFrame:
        return self.kept.filter(F.col("part") == part)

    def labels(self) -> DataFrame:
        """(c, head, digest, count): labels of the text columns; whole ones in head if they were kept whole."""
        return self._part(LABEL).select("c", F.col("s").alias("head"), F.col("d").alias("digest"), F.col("n").alias("count"))

    def value_counts(self) -> DataFrame:
        named = self.labels().select(
            name_of(F.col("c"), self.columns["categorical"]).alias("column"), F.col("head").alias("label"), "count"
        )
        return named.orderBy("column", F.desc("count"), F.asc_nulls_last("label"))

    def buckets(self) -> DataFrame:
        """(c, b, n, lo, hi, s, q): what `grouped_quantiles` counts first."""
        return self._part(NUMBER).select(
            "c", F.col("b").cast("int").alias("b"), F.col("values").alias("n"), "lo", "hi", F.col("total").alias("s"), "q"
        )

    def centres(self) -> list[dict]:
        """Per numeric column: mean, and whether it is constant."""
        found = self.buckets().groupBy("c").agg(
            F.try_divide(F.sum("s"), F.sum("n")).alias("mean"), (F.min("lo") == F.max("hi")).alias("constant")
        )
        rows = {r["c"]: r.asDict() for r in found.collect()}
        return [rows.get(i, {"mean": None, "constant": None}) for i in range(len(self.columns["numeric"]))]

    def datetime_stats(self) -> DataFrame:
        names = self.columns["datetime"]
        return self._part(DATE).select(
            name_of(F.col("c"), names).alias("column"),
            _local(F.col("first")).alias("min_date"), _local(F.col("last")).alias("max_date"),
            F.col("present").alias("total_records"), F.col("different").alias("unique_dates"),
        )

    def rows(self) -> DataFrame:
        """One row: total_rows, distinct_rows, missing (an array with one count per column)."""
        n, mask = F.col("n"), F.col("s")
        missing = [F.coalesce(F.sum(F.when(F.substring(mask, i + 1, 1) == "1", n)), F.lit(0)) for i in range(len(self.names))]
        return self._part(ROW).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum("groups"), F.lit(0)).alias("distinct_rows"),
            F.array(*missing).alias("missing"),
        )

    def missing(self) -> DataFrame:
        """(position, column, missing, missing_pct) per column."""
        rows = self.rows().select("total_rows", F.posexplode("missing").alias("position", "missing"))
        share = F.col("missing") / F.greatest(F.col("total_rows"), F.lit(1)) * 100
        return rows.select("position", name_of(F.col("position"), self.names).alias("column"), "missing", F.round(share, 2).alias("missing_pct"))


def _micros(name: str) -> Column:
    """Local time as a whole number, whatever the session's time zone."""
    value = col(name).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value)


def _local(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string")


def count_all(df: DataFrame, whole_labels: bool = True, duplicates: bool = True, bool_as_numeric: bool = False) -> Counts:
    """Run the pass. ``whole_labels``: keep all labels, else long ones by beginning and digest; ``duplicates``:
    tell equal rows from different ones, else only count them."""
    columns, fields = classify(df, bool_as_numeric), data_fields(df)
    keys = []
    for c, field in enumerate(fields_of(df, columns["categorical"])):
        label = present(field).cast("string")
        head, digest = (label, None) if whole_labels else label_key(label)
        keys.append(_key(LABEL, c, head, digest))
    for c, field in enumerate(fields_of(df, columns["numeric"])):
        value = as_double(field)
        keys.append(_key(NUMBER, c, b=log_bucket(value), v=value))
    for c, name in enumerate(columns["datetime"]):
        keys.append(_key(DATE, c, b=_micros(name)))
    mask = F.concat(*[F.when(present(f).isNull(), "1").otherwise("0") for f in fields])
    keys.append(_key(ROW, -1, mask, _row_digest(df) if duplicates else None))
    counted = df.select(F.inline(F.array(*keys))).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.sum("v").alias("total"), (F.var_pop("v") * F.count("v")).alias("q"),
    )
    part, whole = F.col("part"), F.col("whole")
    reduced = counted.withColumnRenamed("b", "whole").groupBy(
        "part", "c", "s", F.when(part != ROW, F.col("d")).alias("d"), F.when(part != DATE, whole).alias("b")
    ).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum("values").alias("values"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"), F.sum("q").alias("q"),
        F.min(whole).alias("first"), F.max(whole).alias("last"), F.count(whole).alias("different"),
        F.coalesce(F.sum(F.when(whole.isNotNull(), F.col("n"))), F.lit(0)).alias("present"),
    )
    shared_folder(df.sparkSession)
    return Counts(reduced.checkpoint(), columns, [f.name for f in fields])
