"""Table view: search, sort, page."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions.columns import ROW_ID, data_fields, present, sortable
from sheetwise.functions.records import record
from sheetwise.operators.cleaning import text_columns

#: Rows before a page that are sorted along with it.
NEAR_ROWS = 5_000
#: Values that are sampled in each step of the search for a page, and pivots taken from them.
SAMPLE, PIVOTS = 4_096, 16
#: Pivots lie so many standard deviations of a sampled rank around the wanted one.
DEVIATIONS = 4

Key = tuple[Column, bool, T.DataType]


def search_mask(df: DataFrame, pattern: str) -> Column:
    """True where any text column matches the regular expression, ignoring case."""
    if not pattern:
        return F.lit(True)
    hits = [
        F.coalesce(present(df.schema[name]).rlike("(?iu)" + pattern), F.lit(False))
        for name in text_columns(df)
    ]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def search(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(search_mask(df, pattern)) if pattern else df


def _sort_keys(df: DataFrame, sort_col: str | None, sort_dir: str) -> list[Key]:
    """(value, descending, type): the sort column, then the file position; without a position the
    other columns, so that rows equal in all keys are equal rows and pages never overlap."""
    keys = []
    if sort_col and sort_col in df.columns:
        keys.append((df.schema[sort_col], sort_dir.lower() == "desc"))
    if ROW_ID in df.columns:
        keys.append((df.schema[ROW_ID], False))
    else:
        keys += [(f, False) for f in data_fields(df) if f.name != sort_col]
    values = [(sortable(present(f), f.dataType), down) for f, down in keys]
    if not values:
        return []
    forms = df.select(*[value.alias(f"k{i}") for i, (value, _) in enumerate(values)]).schema
    return [(value, down, form.dataType) for (value, down), form in zip(values, forms, strict=True)]


def _order(keys: list[Key]) -> list[Column]:
    return [v.desc_nulls_last() if down else v.asc_nulls_last() for v, down, _ in keys]


def sort_rows(df: DataFrame, sort_col: str | None = None, sort_dir: str = "asc") -> DataFrame:
    """Sort by one column, missing last in both directions; an unknown column is ignored."""
    return df.orderBy(*_order(_sort_keys(df, sort_col, sort_dir)))


def page(
    df: DataFrame,
    page: int = 1,
    page_size: int = 50,
    sort_col: str | None = None,
    sort_dir: str = "asc",
    total_rows: int | None = None,
) -> DataFrame:
    """Rows [(page - 1) * size, page * size) in sorted order.

    Give ``total_rows`` if it is known (`page_info` has it) to spare counting the table.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    start = (page - 1) * page_size
    keys = _sort_keys(df, sort_col, sort_dir)
    if start <= NEAR_ROWS or not keys:
        return df.orderBy(*_order(keys)).offset(start).limit(page_size)
    total = df.count() if total_rows is None else total_rows
    if start >= total:
        return df.limit(0)
    bound, skipped, equal = _locate(df, start, total, keys)
    if not equal:
        rows = df.filter(_from(keys, bound)) if bound else df
        return rows.orderBy(*_order(keys)).offset(start - skipped).limit(page_size)
    # the page starts among rows that are equal in all keys, so equal rows: any of them will do
    values = [value for value, _ in bound]
    run = df.filter(_same(keys, values)).limit(min(page_size, skipped + equal - start))
    rest = page_size - min(page_size, skipped + equal - start)
    if not rest:
        return run
    later = df.filter(_from(keys, [*bound[:-1], (bound[-1][0], False)])).orderBy(*_order(keys)).limit(rest)
    return run.unionByName(later).orderBy(*_order(keys))


def _locate(df: DataFrame, start: int, left: int, keys: list[Key]):
    """Where to begin reading for row ``start`` of the sorted table of ``left`` rows.

    Returns a bound, the number of rows before it, and, if the row lies among rows that are equal
    in all keys, how many those are. The bound is a list of (value, inclusive) of leading sort keys.

    Key after key, only the key itself and those before it are read. A sample gives pivots close to
    the wanted rank, one count of the rows before, at and behind each tells between which two the row lies, and
    so on until few rows are left before it. If it lies in a run of one value, the next key
    takes over. A step leaves about a three-hundredth of the rows.
    """
    names = [f"k{i}" for i in range(len(keys))]
    table = df.select(*[value.alias(name) for name, (value, _, _) in zip(names, keys, strict=True)])
    named = [(F.col(name), down, dtype) for name, (_, down, dtype) in zip(names, keys, strict=True)]
    prefix, skipped, steps = [], 0, 0
    for key in named:
        rows = table.filter(_same(named, prefix)) if prefix else table
        low, run = None, False  # (value,) below which no row is in question
        while start - skipped > NEAR_ROWS and not run:
            steps += 1
            pivots = _pivots(rows, key, (start - skipped) / left, left, steps)
            if not pivots:
                continue
            counts = _counted(rows, key, pivots)
            before, at = 0, 0
            while skipped + before + counts.get(at, 0) <= start:
                before += counts.get(at, 0)
                at += 1
            skipped, left = skipped + before, counts[at]
            if at % 2:  # rows with the value of a pivot
                prefix.append(pivots[at // 2])
                run = True
                continue
            if at:
                low = (pivots[at // 2 - 1],)
                rows = rows.filter(~(_before(key, low[0]) | _same([key], low)))
            if at // 2 < len(pivots):
                rows = rows.filter(_before(key, pivots[at // 2]))
        if not run:
            return [*[(p, True) for p in prefix], *([(low[0], False)] if low else [])], skipped, 0
    return [(p, True) for p in prefix], skipped, left


def _pivots(rows: DataFrame, key: Key, share: float, left: int, seed: int) -> list:
    """Values of a sample around the rank at ``share`` of the rows, in order."""
    sampled = rows.select(key[0]).sample(min(1.0, SAMPLE / left), seed=seed)
    values = [r[0] for r in sampled.orderBy(*_order([key])).collect()]
    spread = DEVIATIONS * (math.sqrt(len(values) * share * (1 - share)) + 1)
    first, last = share * len(values) - spread, share * len(values) + spread
    places = sorted({min(max(round(first + (last - first) * i / (PIVOTS - 1)), 0), len(values) - 1) for i in range(PIVOTS)})
    found: list = []
    for place in places if values else []:
        if not found or values[place] != found[-1]:
            found.append(values[place])
    return found


def _counted(rows: DataFrame, key: Key, pivots: list) -> dict[int, int]:
    """Rows at each place. Through a lambda the key is evaluated once a row, not in every branch."""
    value, down, dtype = key
    place = F.transform(F.array(value), lambda v: _place((v, down, dtype), pivots, 0, len(pivots)))
    return dict(rows.groupBy(place[0].alias("place")).count().collect())


def _place(key: Key, pivots: list, first: int, last: int) -> Column:
    """``2 * i + 1`` at pivot ``i``, ``2 * i`` between it and the one before; halving, so few comparisons."""
    if first == last:
        return F.lit(2 * first)
    middle = (first + last) // 2
    lower, upper = _place(key, pivots, first, middle), _place(key, pivots, middle + 1, last)
    return F.when(_before(key, pivots[middle]), lower).when(_same([key], [pivots[middle]]), 2 * middle + 1).otherwise(upper)


def _before(key: Key, at) -> Column:
    """Whether a row comes before those with the value ``at``, missing last."""
    value, down, dtype = key
    if at is None:
        return value.isNotNull()
    pivot = _literal(at, dtype)
    return F.coalesce((value > pivot) if down else (value < pivot), F.lit(False))


def _same(keys: list[Key], values) -> Column:
    """Whether the leading keys have these values."""
    equal = (k.eqNullSafe(_literal(v, dtype)) for (k, _, dtype), v in zip(keys, values, strict=False))
    return reduce(lambda all_, x: all_ & x, equal)


def _from(keys: list[Key], bound: list[tuple[object, bool]]) -> Column:
    """Whether a row comes at or after the bound; at it only where the last value is inclusive."""
    later, same = F.lit(False), F.lit(True)
    for key, (at, _) in zip(keys, bound, strict=False):
        equal = _same([key], [at])
        later = later | (same & ~_before(key, at) & ~equal)
        same = same & equal
    return later | same if bound[-1][1] else later


def page_after(
    df: DataFrame,
    last: dict,
    page_size: int = 50,
    sort_col: str | None = None,
    sort_dir: str = "asc",
) -> DataFrame:
    """The page that follows the row ``last`` (a value per column, or the row's ``_row_id``).

    Each step keeps only page_size rows per task, however deep the page is.
    """
    keys = _sort_keys(df, sort_col, sort_dir)
    named = [sort_col] if sort_col and sort_col in df.columns else []
    tail = [ROW_ID] if ROW_ID in df.columns else [f.name for f in data_fields(df) if f.name != sort_col]
    later, same = F.lit(False), F.lit(True)
    for name, (value, down, _) in zip([*named, *tail], keys, strict=True):
        dtype = df.schema[name].dataType
        at = sortable(_literal(last[name], dtype), dtype)
        beyond = (value < at) if down else (value > at)
        later = later | (same & F.coalesce(beyond | (value.isNull() & at.isNotNull()), F.lit(False)))
        same = same & value.eqNullSafe(at)
    return df.filter(later).orderBy(*_order(keys)).limit(page_size)


def _literal(value, dtype: T.DataType) -> Column:
    """A collected value as a literal of its type."""
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return F.array(*[_literal(v, dtype.elementType) for v in value]) if value else F.array().cast(dtype)
    if isinstance(dtype, T.MapType):
        entries = [_literal(x, t) for k, v in value.items() for x, t in ((k, dtype.keyType), (v, dtype.valueType))]
        return F.create_map(*entries) if value else F.create_map().cast(dtype)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(str(value)).cast(dtype)  # as text: no shift by the session time zone
    return F.lit(bytes(value) if isinstance(value, bytearray) else value).cast(dtype)


def page_info(
    df: DataFrame, pattern: str = "", page: int = 1, page_size: int = 50
) -> DataFrame:
    """One row: total_rows, filtered_rows, page, page_size, total_pages."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(search_mask(df, pattern)).alias("filtered_rows"),
    )
    pages = F.ceil(F.col("filtered_rows") / page_size)
    return counted.select(
        "total_rows",
        "filtered_rows",
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        F.greatest(F.lit(1), pages).cast("bigint").alias("total_pages"),
    )


def records(df: DataFrame) -> DataFrame:
    """One JSON text per row, in the column ``record``."""
    return df.select(record(df).alias("record"))


def table_view(
    df: DataFrame,
    page_number: int = 1,
    page_size: int = 50,
    sort_col: str | None = None,
    sort_dir: str = "asc",
    pattern: str = "",
) -> dict[str, DataFrame]:
    """One page of records and the numbers around it."""
    rows = page(search(df, pattern), page_number, page_size, sort_col, sort_dir)
    return {"records": records(rows), "info": page_info(df, pattern, page_number, page_size)}
