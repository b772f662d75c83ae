"""Equal-width histogram with right-closed bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.columns import as_double, name_of
from sheetwise.operators.quantiles import log_bucket
from sheetwise.operators.schema import column_class
from sheetwise.session import shared_folder

EMPTY = "bin int, lo double, hi double, label string, count bigint"


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row per bin, empty bins included: (bin, lo, hi, label, count).

    Bin i covers (lo, hi]. The first edge is lowered by 0.1 % of the range so that the
    minimum falls inside; a constant column gets a range of 0.1 % around its value. A column
    that is unknown, not numeric or without values gives no rows.

    The range is one scalar subquery (its own pass over the column) and the bin an arithmetic guess corrected by comparing
    with the edges, so the cost per value does not depend on the number of bins; only one
    count per bin and task is shuffled.
    """
    if bins < 1:
        raise ValueError("bins must be positive")
    names = df.columns
    if column not in names or column_class(df.schema[column].dataType, True) != "numeric":
        return df.sparkSession.createDataFrame([], EMPTY)

    values = df.select(as_double(df.schema[column]).alias("v")).filter(F.col("v").isNotNull())
    limits = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = limits.select(_span(bins, _raise).alias("span")).scalar().alias("span")
    placed = values.select("v", span).select(_bin(F.col("v"), F.col("span"), bins).alias("bin"), F.lit(1).alias("one"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"), span)
    frame = every.filter(F.col("span").isNotNull()).select("bin", F.lit(0).alias("one"))
    counted = frame.unionByName(placed).groupBy("bin").agg(F.sum("one").alias("count"))
    return counted.select("bin", "count", span).select(*_described(bins)).orderBy("bin")


def histograms(
    df: DataFrame, columns: list[str], bins: int = 10, counted: DataFrame | None = None, strict: bool = True
) -> DataFrame:
    """The histograms of several numeric columns: (column, bin, lo, hi, label, count).

    One pass counts the values per logarithmic bucket of `quantiles` (or ``counted`` is given: c, b, n, lo, hi). A
    bucket whose least and largest value fall into the same bin is counted as a whole; a second pass reads the
    values of the others, at most one for each inner edge. Columns without values have no rows, nor, unless ``strict``, those
    whose range cannot be cut into bins.
    """
    if bins < 1:
        raise ValueError("bins must be positive")
    if not columns:
        return df.sparkSession.createDataFrame([], f"column string, {EMPTY}")
    cells = [F.struct(F.lit(i).alias("c"), as_double(df.schema[n]).alias("v")) for i, n in enumerate(columns)]
    values = df.select(F.inline(F.array(*cells))).filter(F.col("v").isNotNull()).withColumn("b", log_bucket(F.col("v")))
    if counted is None:
        counted = values.groupBy("c", "b").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        shared_folder(df.sparkSession)
        counted = counted.checkpoint()
    limits = counted.groupBy("c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = limits.select("c", _span(bins, _raise if strict else lambda _: F.lit(None)).alias("span")).filter("span IS NOT NULL")
    spans = F.broadcast(spans)  # one row per column
    first, last = (_bin(F.col(end), F.col("span"), bins) for end in ("lo", "hi"))
    buckets = counted.filter("n > 0").join(spans, "c").select("c", "b", "n", "span", first.alias("first"), last.alias("last"))
    whole = buckets.filter("first = last").select("c", F.col("first").alias("bin"), "n")
    cut = F.broadcast(buckets.filter("first < last").select("c", "b", "span"))  # an edge cuts one bucket
    read = values.join(cut, ["c", "b"]).select("c", _bin(F.col("v"), F.col("span"), bins).alias("bin"), F.lit(1).cast("bigint").alias("n"))
    frame = spans.select("c", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), F.lit(0).cast("bigint").alias("n"))
    sums = frame.unionByName(whole).unionByName(read).groupBy("c", "bin").agg(F.sum("n").alias("count"))
    name = name_of(F.col("c"), columns).alias("column")
    return sums.join(spans, "c").select(name, *_described(bins)).orderBy("column", "bin")


def _raise(problem: str) -> Column:
    return F.raise_error(F.lit(f"histogram: the {problem}"))


def _edge(span: Column, i: Column, bins: int) -> Column:
    return F.when(i == bins, span["stop"]).otherwise(span["start"] + i * span["width"])


def _bin(value: Column, span: Column, bins: int) -> Column:
    """An arithmetic guess, corrected by the edges."""
    guess = F.ceil((value - span["start"]) / span["width"]).cast("int")
    guess = F.least(F.greatest(guess, F.lit(1)), F.lit(bins))
    return (
        F.when(span["inner"].isNotNull(), _search(span["inner"], value))
        .when((guess > 1) & (value <= _edge(span, guess - 1, bins)), guess - 1)
        .when((guess < bins) & (value > _edge(span, guess, bins)), guess + 1)
        .otherwise(guess)
    )


def _described(bins: int) -> list[Column]:
    """bin, lo, hi, label, count of rows with bin, span and count."""
    span, number = F.col("span"), F.col("bin")
    lo = F.when(number == 1, span["first"]).otherwise(_edge(span, number - 1, bins))
    hi = _edge(span, number, bins)
    return [number, lo.alias("lo"), hi.alias("hi"), F.format_string("%.2f-%.2f", lo, hi).alias("label"), F.col("count")]


def _search(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < value)) + 1


def _span(bins: int, refuse) -> Column:
    """Struct from ``lo`` and ``hi``: start, stop, width, the lowered first edge, and, if the bins are
    hardly wider than the gaps between doubles, the inner edges; NULL if no value."""
    lo, hi = F.col("lo"), F.col("hi")
    margin = F.when(lo == 0, 0.001).otherwise(F.abs(lo) * 0.001)
    infinite = (hi == float("inf")) | (lo == float("-inf"))
    start = F.when(lo == hi, lo - margin).otherwise(lo)
    stop = F.when(lo == hi, hi + margin).otherwise(hi)
    first = F.when(lo == hi, start).otherwise(lo - (hi - lo) * 0.001)
    width = (stop - start) / bins
    inner = F.transform(
        F.sequence(F.lit(1), F.lit(bins - 1)) if bins > 1 else F.array().cast("array<int>"),
        lambda i: start + i * width,
    )
    tight = width < F.greatest(F.abs(start), F.abs(stop)) * 1e-14
    span = F.struct(
        start.alias("start"),
        stop.alias("stop"),
        width.alias("width"),
        first.alias("first"),
        F.when(tight, inner).alias("inner"),
    )
    unusable = (width <= 0) | (width == float("inf")) | (F.abs(first) == float("inf"))
    return (
        F.when(infinite, refuse("column holds infinite values"))
        .when(unusable, refuse("range of the column cannot be cut into bins"))
        .when(lo.isNotNull(), span)
    )
