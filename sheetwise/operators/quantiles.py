"""Exact quantiles, per key, without gathering the values of a key in one place.

The built-in `percentile` keeps every distinct value of a group in one task. Here a value
first falls into a bucket by its binary logarithm; only counts per bucket are shuffled, and
a running count over the buckets of a key tells which bucket holds each wanted rank. The
values of those buckets alone are read again, in narrower buckets while one is still large,
and at last value by value. A key has at most about 146,000 logarithmic buckets and 65,536
narrow ones, so neither the running count nor the last step grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.columns import null_if_nan
from sheetwise.session import shared_folder

#: A bucket with more rows than this is split again before it is read value by value.
BUCKET_ROWS = 1_000_000
#: Equal parts that a large bucket is split into.
SPLITS = 65_536
#: The table of wanted buckets is broadcast up to this size.
BROADCAST_BYTES = 32 << 20
#: Size of one of its rows without the key.
STATE_ROW_BYTES = 200

CARRIED = ["count", "total", "min", "max", "mean", "m2"]


def log_bucket(value: Column) -> Column:
    """Bucket that never decreases as the value grows: 32 steps per power of two."""
    magnitude = F.abs(value)
    steps = (
        F.when(value == 0, 0)
        .when(magnitude == float("inf"), 100_000)
        .otherwise(F.floor(F.log2(magnitude) * 32) + 40_000)
    )
    return (F.signum(value) * steps).cast("int")


def narrow_bucket(value: Column, lo: Column, hi: Column) -> Column:
    """Equal parts of [lo, hi]; the ends fall into different parts."""
    return F.floor((value - lo) / (hi - lo) * SPLITS).cast("int")


def grouped_quantiles(
    values: DataFrame,
    keys: list[str],
    probabilities: list[float],
    reread: Callable[[list], DataFrame] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Count, total, min, max, mean, std and quantiles of column ``v`` per key.

    ``values`` has the keys (not missing) and a double ``v``; missing values count only
    towards the presence of the key. Quantiles interpolate between neighbours and come as
    columns q0, q1, …

    Give ``reread`` when there is one key column whose number of values is bounded by the
    schema: it returns the values of the given keys, so that later passes read less. Give ``counted`` (keys, b,
    n, lo, hi, s, q) if the buckets have been counted already.
    """
    shared_folder(values.sparkSession)
    base = _bucketed(values, keys)
    if counted is None:
        counted = base.groupBy(*keys, "b").agg(
            F.count("v").alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.sum("v").alias("s"),
            (F.var_pop("v") * F.count("v")).alias("q"),
        )
    key = Window.partitionBy(*keys)
    below = F.sum("n").over(key.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    deviation = F.try_divide("s", "n") - F.col("mean")
    state = (
        counted.withColumns(
            {
                "below": F.coalesce(below, F.lit(0)),
                "count": F.sum("n").over(key),
                "total": F.sum("s").over(key),
                "min": F.min("lo").over(key),
                "max": F.max("hi").over(key),
            }
        )
        .withColumn("mean", F.try_divide("total", "count"))
        .withColumn("m2", F.sum(F.col("q") + F.col("n") * deviation * deviation).over(key))
        .withColumn("ranks", _ranks_inside(_wanted(probabilities)))
        .filter((F.size("ranks") > 0) | (F.col("count") == 0))
        .select(*keys, "b", *CARRIED, "below", "ranks", "lo", "hi", "n")
        .checkpoint()
    )

    # A wanted bucket with more than one value is open. A split separates its lowest from its
    # highest value and narrows the range by 65,536, so three splits reach single doubles.
    open_ = F.coalesce(F.col("lo") < F.col("hi"), F.lit(False))
    while True:
        largest, small = _measure(state.filter(open_), keys)
        if reread is not None and largest:
            left = state.filter(open_).select(*keys).distinct().collect()
            base = _bucketed(reread(sorted(row[0] for row in left)), keys)
        if largest <= BUCKET_ROWS:
            break
        wide = open_ & (F.col("n") > BUCKET_ROWS)
        split = _refine(base, state.filter(wide), keys, narrow_bucket, small)
        state = state.filter(~wide).unionByName(split).checkpoint()

    found = state.filter(~open_)
    if largest:
        read = _refine(base, state.filter(open_), keys, lambda v, lo, hi: v, small)
        found = found.unionByName(read)
    ranked = found.select(
        *keys, *CARRIED, F.explode_outer("ranks").alias("rank"), F.col("lo").alias("v")
    )
    return _interpolate(ranked, keys, probabilities)


def _bucketed(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.select(*keys, "v", log_bucket(F.col("v")).alias("b"))


def _measure(state: DataFrame, keys: list[str]) -> tuple[int, bool]:
    """Rows of the largest bucket, and whether the buckets are small enough to broadcast."""
    key_bytes = F.octet_length(F.concat_ws("", *[F.col(k).cast("string") for k in keys]))
    row = state.agg(F.max("n"), F.sum(key_bytes + STATE_ROW_BYTES)).first()
    return row[0] or 0, (row[1] or 0) <= BROADCAST_BYTES


def _position(p: float) -> Column:
    return (F.col("count") - 1) * F.lit(p)


def _wanted(probabilities: list[float]) -> Column:
    ends = [end for p in probabilities for end in (F.floor(_position(p)), F.ceil(_position(p)))]
    return F.array_distinct(F.array(*ends))


def _ranks_inside(ranks: Column) -> Column:
    first, n = F.col("below"), F.col("n")
    return F.filter(ranks, lambda r: (r >= first) & (r < first + n))


def _refine(base: DataFrame, state: DataFrame, keys: list[str], bucket, small: bool) -> DataFrame:
    """Split the buckets in ``state`` and keep the parts that hold a wanted rank.

    A small table of buckets is broadcast, so that only the values inside are shuffled.
    Otherwise the values are counted before the join: one value that fills a group is a
    single row by then.
    """
    wanted = state.drop("n")
    if small:
        counted = base.withColumn("n", F.lit(1))
        wanted = F.broadcast(wanted)
    else:
        counted = base.groupBy(*keys, "b", "v").agg(F.count("v").alias("n"))
    joined = counted.join(wanted, [*keys, "b"])
    inside = joined.filter(F.col("v").between(F.col("lo"), F.col("hi")))
    same = [*keys, "b", *CARRIED, "below", "ranks"]
    placed = inside.select(*same, "v", "n", bucket(F.col("v"), F.col("lo"), F.col("hi")).alias("part"))
    if not small:
        # The sorted join leaves a bucket in one task. Dealing its parts out anew lets the planner
        # split a hot bucket in the join, too, as nothing above relies on its partitioning.
        placed = placed.repartition(*keys, "b", "part")
    parts = (
        placed.groupBy(*same, "part")
        .agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    # `below` is different for every bucket of a key.
    before = (
        Window.partitionBy(*keys, "below")
        .orderBy("part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        parts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("below", F.col("below") + F.col("earlier"))
        .withColumn("ranks", _ranks_inside(F.col("ranks")))
        .filter(F.size("ranks") > 0)
        .select(*same, "lo", "hi", "n")
    )


def _interpolate(found: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    at = []
    for i, p in enumerate(probabilities):
        position = _position(p)
        at += [
            F.max(F.when(F.col("rank") == F.floor(position), F.col("v"))).alias(f"lo{i}"),
            F.max(F.when(F.col("rank") == F.ceil(position), F.col("v"))).alias(f"hi{i}"),
        ]
    out = found.groupBy(*keys, *CARRIED).agg(*at)
    quantiles = []
    for i, p in enumerate(probabilities):
        lo, hi, weight = F.col(f"lo{i}"), F.col(f"hi{i}"), _position(p) - F.floor(_position(p))
        quantiles.append(
            F.when(lo == hi, lo).otherwise(lo + (hi - lo) * weight).alias(f"q{i}")
        )
    std = F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1)))
    return out.select(
        *keys, "count", "total", "min", "max",
        null_if_nan(F.col("mean")).alias("mean"), null_if_nan(std).alias("std"), *quantiles,
    )
