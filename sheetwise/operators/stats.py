"""Value counts, numeric and datetime statistics, correlation, group aggregates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions.columns import (
    as_double, chunks, col, name_of, null_if_nan, present, row_key,
)
from sheetwise.operators.quantiles import grouped_quantiles
from sheetwise.operators.schema import classify, column_class, fields_of
from sheetwise.session import shared_folder

# The statistics that a metric card can show.
METRICS = ("mean", "median", "sum", "min", "max")

#: Characters of a long label that are shuffled with its digest.
HEAD = 64
#: Long labels of the result up to which their digests (about a hundred bytes each) are broadcast.
BROADCAST_LABELS = 100_000


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


# --- categories ------------------------------------------------------------------------


def _labels(df: DataFrame, columns: list[str], label) -> DataFrame:
    labels = df.select(*[label(f).cast("string").alias(f.name) for f in fields_of(df, columns)])
    return labels.unpivot([], [col(c) for c in columns], "column", "label")


def label_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, label, count) for all categorical columns in one scan, missing included."""
    columns = classify(df)["categorical"] if columns is None else columns
    if not columns:
        return _empty(df, "column string, label string, count bigint")
    counted = _labels(df, columns, present).groupBy("column", "label")
    return counted.agg(F.count(F.lit(1)).alias("count"))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Label counts, most frequent first within a column; ties by label, missing last."""
    counted = label_counts(df, columns)
    return counted.orderBy("column", F.desc("count"), F.asc_nulls_last("label"))


def _label_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, label): the number of a column and its labels, one row per cell."""
    cells = [
        F.struct(F.lit(i).alias("c"), present(f).cast("string").alias("label"))
        for i, f in enumerate(fields_of(df, columns))
    ]
    return df.select(F.inline(F.array(*cells)))


def label_key(label: Column) -> list[Column]:
    """What stands for a label in a shuffle: short ones themselves, long ones a beginning and a digest."""
    long = F.char_length(label) > HEAD
    return [F.substring(label, 1, HEAD).alias("head"), F.when(long, F.unhex(F.sha2(label, 256))).alias("digest")]


def counted_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, head, digest, count): labels counted without moving the texts of long ones."""
    keys = _label_cells(df, columns).select("c", *label_key(F.col("label")))
    return keys.groupBy("c", "head", "digest").agg(F.count(F.lit(1)).alias("count"))


def top_categories(
    df: DataFrame, n: int = 10, columns: list[str] | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """The n most frequent labels of every categorical column: (column, position, label, count).

    Labels are counted by `label_key`, and the n best by count and beginning stay, with all that tie
    with the last of them. Only if some of those are long, the table is read again for their texts. Give ``counted``
    if the labels have been counted already.
    """
    columns = classify(df)["categorical"] if columns is None else columns
    if not columns:
        return _empty(df, "column string, position int, label string, count bigint")
    shared_folder(df.sparkSession)
    best = Window.partitionBy("c").orderBy(F.desc("count"), F.asc_nulls_last("head"))
    counted = counted_labels(df, columns) if counted is None else counted
    kept = counted.withColumn("at", F.rank().over(best)).filter(F.col("at") <= n).drop("at").checkpoint()
    long = kept.filter(F.col("digest").isNotNull())
    wanted = long.count()
    labels = kept.filter(F.col("digest").isNull()).select("c", F.col("head").alias("label"), "count")
    if wanted:
        keys = long.select("c", "digest", "count")
        texts = _label_cells(df, columns).filter(F.char_length("label") > HEAD)
        texts = texts.withColumn("digest", label_key(F.col("label"))[1])
        found = texts.join(F.broadcast(keys) if wanted <= BROADCAST_LABELS else keys, ["c", "digest"])
        labels = labels.unionByName(
            found.groupBy("c", "digest", "count").agg(F.any_value("label").alias("label")).drop("digest")
        )
    ranked = Window.partitionBy("c").orderBy(F.desc("count"), F.asc_nulls_last("label"))
    placed = labels.withColumn("position", F.row_number().over(ranked)).filter(F.col("position") <= n)
    return placed.select(name_of(F.col("c"), columns).alias("column"), "position", "label", "count")


def distinct_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, labels): number of different labels, missing counted as one.

    Long labels are compared by digest, so the shuffle does not carry whole texts.
    """
    different = _labels(df, columns, row_key).distinct()
    return different.groupBy("column").agg(F.count(F.lit(1)).alias("labels"))


# --- numbers ---------------------------------------------------------------------------


def numeric_stats(
    df: DataFrame,
    columns: list[str] | None = None,
    approx: bool = False,
    bool_as_numeric: bool = False,
    counted: DataFrame | None = None,
) -> DataFrame:
    """One row per numeric column: position, column, count, min, max, mean, median, std, q1,
    q3, sum.

    Exact by default (see `quantiles`); ``approx=True`` takes `percentile_approx` quartiles
    in a single pass. Give ``counted`` if the buckets have been counted already.
    """
    columns = classify(df, bool_as_numeric)["numeric"] if columns is None else columns
    if not columns:
        return _empty(
            df,
            "position int, column string, count bigint, min double, max double, mean double, "
            "median double, std double, q1 double, q3 double, sum double",
        )
    fields = fields_of(df, columns)
    quartiles = [0.25, 0.5, 0.75]

    def cells(positions) -> DataFrame:
        values = [
            F.struct(F.lit(i).alias("c"), as_double(fields[i]).alias("v")) for i in positions
        ]
        return df.select(F.inline(F.array(*values)))

    values = cells(range(len(fields)))
    if approx:
        points = F.percentile_approx("v", quartiles, 10_000)
        found = values.groupBy("c").agg(
            F.count("v").alias("count"), F.sum("v").alias("total"), F.min("v").alias("min"),
            F.max("v").alias("max"), F.avg("v").alias("mean"),
            null_if_nan(F.stddev_samp("v")).alias("std"),
            *[points[i].alias(f"q{i}") for i in range(3)],
        )
    else:
        found = grouped_quantiles(values, ["c"], quartiles, reread=cells, counted=counted)
    listed = F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("c")
    every = df.sparkSession.range(1).select(listed)
    return (
        every.join(F.broadcast(found), "c", "left").select(
            F.col("c").alias("position"), name_of(F.col("c"), columns).alias("column"),
            F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
            "min", "max", F.round("mean", 2).alias("mean"), F.col("q1").alias("median"),
            F.round("std", 2).alias("std"), F.col("q0").alias("q1"), F.col("q2").alias("q3"),
            F.coalesce("total", F.lit(0.0)).alias("sum"),
        )
    )


def metric_cards(stats: DataFrame, metric: str = "mean") -> DataFrame:
    """(column, value): one chosen statistic per numeric column, at two decimals."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    return stats.select("position", "column", F.round(metric, 2).alias("value"))


def context_stats(df: DataFrame, approx: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """Mean, median, min, max and std at two decimals; booleans count as 0 and 1."""
    stats = numeric_stats(df, approx=approx, bool_as_numeric=True, counted=counted)
    return stats.select(
        "position", "column",
        *[F.round(n, 2).alias(n) for n in ("mean", "median", "min", "max", "std")],
    )


def datetime_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min_date, max_date, total_records, unique_dates), distinct count exact.

    Values are counted per column first, so equal timestamps travel once per task.
    """
    columns = classify(df)["datetime"] if columns is None else columns
    if not columns:
        return _empty(
            df,
            "column string, min_date string, max_date string, total_records bigint, "
            "unique_dates bigint",
        )
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("c"), col(name).cast("timestamp_ntz").alias("v"))
            for i, name in enumerate(columns)
        ]
    )
    per_value = df.select(F.inline(cells)).groupBy("c", "v").agg(F.count("v").alias("n"))
    return (
        per_value.groupBy("c")
        .agg(
            F.min("v").cast("string").alias("min_date"),
            F.max("v").cast("string").alias("max_date"),
            F.sum("n").alias("total_records"),
            F.count("v").alias("unique_dates"),
        )
        .select(
            name_of(F.col("c"), columns).alias("column"),
            "min_date", "max_date", "total_records", "unique_dates",
        )
    )


# --- correlation -----------------------------------------------------------------------


def correlation(
    df: DataFrame,
    columns: list[str] | None = None,
    bool_as_numeric: bool = False,
    centres: list[dict] | None = None,
) -> DataFrame:
    """Pearson correlation of every pair of numeric columns: (col_a, col_b, corr).

    A pair uses the rows where both are present; a constant column gives NULL. Fewer than
    two numeric columns give no rows.

    A first pass takes mean and range per column (or ``centres`` has them). The second is one scan, whatever the number
    of columns and gaps: each batch of rows centred on those means gives the sums of all pairs
    by matrix products with the mask of present values, and each task sends on one row per
    pair. Only pairs whose spread is within rounding of zero are read a third time, for their
    exact range. The driver gets one row per pair of columns.
    """
    columns = classify(df, bool_as_numeric)["numeric"] if columns is None else columns
    if len(columns) < 2:
        return _empty(df, "col_a string, col_b string, corr double")
    values = [as_double(f) for f in fields_of(df, columns)]
    table = df.select(*[v.alias(f"x{i}") for i, v in enumerate(values)])
    centres = _centres(table, len(columns)) if centres is None else centres
    means = [c["mean"] if math.isfinite(c["mean"] or 0.0) else 0.0 for c in centres]
    means = [m or 0.0 for m in means]
    sums = (
        table.mapInArrow(_pair_sums(means), PAIR_SUMS)
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")])
        .collect()
    )
    constant = {i for i, c in enumerate(centres) if c["constant"] or not math.isfinite(c["mean"] or 0.0)}
    found, doubtful = {}, []
    for row in sums:
        i, j, n = row["i"], row["j"], row["n"]
        if n == 0 or i in constant or j in constant:
            found[i, j] = None
            continue
        x, y = row["xx"] - row["sx"] ** 2 / n, row["yy"] - row["sy"] ** 2 / n
        if x <= ROUNDING * row["xx"] or y <= ROUNDING * row["yy"]:
            doubtful.append((i, j))
        spread = math.sqrt(x) * math.sqrt(y) if x > 0 and y > 0 else 0.0
        ratio = (row["xy"] - row["sx"] * row["sy"] / n) / spread if spread else None
        found[i, j] = None if ratio is None or math.isnan(ratio) else max(-1.0, min(1.0, ratio))
    for pair in _flat_pairs(table, doubtful):
        found[pair] = None
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            value = found.get((min(i, j), max(i, j)))
            rows.append((a, b, 1.0 if i == j and value is not None else value))
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


PAIR_SUMS = "i int, j int, n bigint, sx double, sy double, xx double, yy double, xy double"

#: Spread of a pair, as a share of its sum of squares, that may be rounding alone.
ROUNDING = 1e-9


def _matrix(batch, n: int) -> np.ndarray:
    """Rows of a batch as doubles, missing as NaN."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)], axis=1)


def _pair_sums(means: list[float]):
    """Sums over the rows where both columns of a pair are present, one row per pair and task."""
    size = len(means)

    def add(batches):
        total = np.zeros((4, size, size))
        for batch in batches:
            values = _matrix(batch, size) - np.array(means)
            there = (~np.isnan(values)).astype(float)
            values = np.where(there > 0, values, 0.0)
            # counts; sums of i where j is there; squares of i where j is there; products
            total += [there.T @ there, values.T @ there, (values * values).T @ there, values.T @ values]
        i, j = np.triu_indices(size)
        count, first, square, product = total
        columns = [i, j, count[i, j], first[i, j], first[j, i], square[i, j], square[j, i], product[i, j]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5]
        names = ["i", "j", "n", "sx", "sy", "xx", "yy", "xy"]
        arrays = [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return add


def _flat_pairs(table: DataFrame, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs of which one column is constant over the rows where both are present."""
    if not pairs:
        return []
    size = len(table.columns)

    def ranges(batches):
        low, high = np.full((len(pairs), 2), np.inf), np.full((len(pairs), 2), -np.inf)
        for batch in batches:
            values = _matrix(batch, size)
            there = ~np.isnan(values)
            for k, (i, j) in enumerate(pairs):
                both = values[there[:, i] & there[:, j]][:, [i, j]]
                if len(both):
                    low[k], high[k] = np.minimum(low[k], both.min(0)), np.maximum(high[k], both.max(0))
        columns = [np.arange(len(pairs)), *low.T, *high.T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "lx", "ly", "hx", "hy"])

    read = table.mapInArrow(ranges, "k bigint, lx double, ly double, hx double, hy double")
    flat = read.groupBy("k").agg(F.min("lx") == F.max("hx"), F.min("ly") == F.max("hy"))
    return [pairs[k] for k, x, y in flat.collect() if x or y]


def _centres(table: DataFrame, n: int) -> list[dict]:
    """Per column: mean, and whether it is constant."""
    rows = {}
    for part in chunks(list(range(n)), 40):
        entries = F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"),
                    F.avg(f"x{i}").alias("mean"),
                    (F.min(f"x{i}") == F.max(f"x{i}")).alias("constant"),
                )
                for i in part
            ]
        )
        for row in table.agg(entries.alias("e")).select(F.inline("e")).collect():
            rows[row["i"]] = row.asDict()
    return [rows[i] for i in range(n)]


# --- groups ----------------------------------------------------------------------------


def group_aggregate(df: DataFrame, x: str, y: str, aggregation: str = "sum") -> DataFrame:
    """(label, value) of ``y`` per value of ``x``, by label; missing keys are dropped.

    Any aggregation other than mean, min, max, median and count is a sum; the sum of a group
    without values is 0.
    """
    key, field = df.schema[x], df.schema[y]
    numeric = column_class(field.dataType, bool_as_numeric=True) == "numeric"
    if not numeric and aggregation not in ("min", "max", "count"):
        raise ValueError(f"{aggregation or 'sum'} needs a numeric column, {y!r} is not")
    value = as_double(field) if numeric else present(field)
    rows = df.select(present(key).alias("label"), value.alias("v"))
    rows = rows.filter(F.col("label").isNotNull())
    if aggregation == "median":
        found = grouped_quantiles(rows, ["label"], [0.5]).select("label", F.col("q0").alias("value"))
    else:
        functions = {"mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
        total = functions.get(aggregation, lambda v: F.coalesce(F.sum(v), F.lit(0.0)))("v")
        found = rows.groupBy("label").agg(total.alias("value"))
    if isinstance(found.schema["value"].dataType, T.LongType):
        found = found.withColumn("value", F.col("value").cast("double"))
    return found.orderBy("label")


def timeline(df: DataFrame, column: str) -> DataFrame:
    """(label, value): rows per day of a datetime column."""
    day = F.date_trunc("day", col(column)).cast(df.schema[column].dataType)
    return (
        df.filter(col(column).isNotNull())
        .groupBy(day.alias("label"))
        .agg(F.count(F.lit(1)).alias("value"))
        .orderBy("label")
    )
