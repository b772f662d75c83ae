"""Value counts, statistics, correlation, histograms, group aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.catalog.registry import (
    DIRTY_LINEITEM, ORDERS_WITH_GAPS, dirty_lineitem, orders_with_gaps, query, table,
)
from sheetwise.operators import stats
from sheetwise.operators.histogram import histogram


def _counts_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS label, count(*) AS count "
        f"FROM {source} GROUP BY {c}"
        for c in columns
    )


def _top_sql(source: str, columns: list[str], n: int) -> str:
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, label NULLS LAST)
         AS position
  FROM ({_counts_sql(source, columns)}))
SELECT "column", CAST(position AS INTEGER) AS position, label, count FROM ranked WHERE position <= {n}"""


def _numeric_sql(source: str, columns: list[str], digits: int = 4) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS count, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
        f"round(avg({c}), 2) AS mean, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), {digits}) AS median, "
        f"round(stddev_samp({c}), 2) AS std, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), {digits}) AS q1, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), {digits}) AS q3, "
        f"round(coalesce(sum(CAST({c} AS DOUBLE)), 0), 2) AS sum FROM {source}"
        for i, c in enumerate(columns)
    )


def _rounded(found, digits: int = 4):
    for name in ("median", "q1", "q3"):
        found = found.withColumn(name, F.round(name, digits))
    return found.withColumn("sum", F.round("sum", 2))


LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]


@query(_counts_sql("customer", ["c_name", "c_mktsegment"]))
def value_counts(spark, sf_dir):
    return stats.value_counts(table(spark, sf_dir, "customer"))


@query(f"WITH {DIRTY_LINEITEM} {_counts_sql('dirty', ['l_returnflag', 'l_linestatus'])}")
def value_counts_with_missing(spark, sf_dir):
    return stats.value_counts(dirty_lineitem(spark, sf_dir))


@query(f"WITH {_top_sql('part', ['p_name', 'p_brand', 'p_type'], 10)}")
def top_categories(spark, sf_dir):
    return stats.top_categories(table(spark, sf_dir, "part"))


@query(f"WITH {_top_sql('documents', ['text', 'lang', 'source'], 10)}")
def top_categories_of_texts(spark, sf_dir):
    return stats.top_categories(table(spark, sf_dir, "documents"))


@query(f"WITH {DIRTY_LINEITEM} {_numeric_sql('dirty', LINEITEM_NUMBERS)}")
def numeric_stats(spark, sf_dir):
    return _rounded(stats.numeric_stats(dirty_lineitem(spark, sf_dir)))


@query(_numeric_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]))
def numeric_stats_of_customers(spark, sf_dir):
    return _rounded(stats.numeric_stats(table(spark, sf_dir, "customer")))


def _context_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", round(avg({c}), 2) AS mean, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS median, "
        f"round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max, "
        f"round(stddev_samp({c}), 2) AS std FROM {source}"
        for i, c in enumerate(columns)
    )


@query(f"""
WITH marked AS (SELECT event_id, user_id, value, CAST(value > 100 AS INTEGER) AS high FROM events)
{_context_sql('marked', ['event_id', 'user_id', 'value', 'high'])}
""")
def context_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("high", F.col("value") > 100)
    return stats.context_stats(events)


@query("""
SELECT 0 AS position, 'event_id' AS "column", round(CAST(sum(event_id) AS DOUBLE), 2) AS value FROM events
UNION ALL SELECT 1, 'user_id', round(CAST(sum(user_id) AS DOUBLE), 2) FROM events
UNION ALL SELECT 2, 'value', round(sum(value), 2) FROM events
""")
def metric_cards(spark, sf_dir):
    return stats.metric_cards(stats.numeric_stats(table(spark, sf_dir, "events")), "sum")


CORRELATED = [*LINEITEM_NUMBERS, "flat"]


@query(f"WITH {DIRTY_LINEITEM}, wide AS (SELECT *, 7 AS flat FROM dirty) " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 6) + 0.0 END AS corr FROM wide"
    for a in CORRELATED
    for b in CORRELATED
))
def correlation(spark, sf_dir):
    wide = dirty_lineitem(spark, sf_dir).withColumn("flat", F.lit(7))
    found = stats.correlation(wide.select(*CORRELATED))
    return found.withColumn("corr", F.round("corr", 6) + F.lit(0.0))


WIDE = [f"c{i}" for i in range(40)]


def _wide_column(i: int) -> str:
    """Every column has gaps of its own."""
    return f"CASE WHEN l_orderkey % {i + 2} <> 0 THEN l_quantity * {i + 1} + l_partkey % {7 * i + 3} END"


@query(f"""
WITH wide AS (SELECT {', '.join(f'CAST({_wide_column(i)} AS DOUBLE) AS c{i}' for i in range(40))} FROM lineitem)
SELECT unnest([{', '.join(
    f"{{'col_a': '{a}', 'col_b': '{b}', 'corr': round(corr({a}, {b}), 5) + 0.0}}" for a in WIDE for b in WIDE
)}], recursive := true) FROM wide
""")
def correlation_wide(spark, sf_dir):
    """Forty columns with gaps, in one scan."""
    lines = table(spark, sf_dir, "lineitem")
    found = stats.correlation(lines.select(*[F.expr(_wide_column(i)).cast("double").alias(f"c{i}") for i in range(40)]))
    return found.withColumn("corr", F.round("corr", 5) + F.lit(0.0))


@query("""
SELECT 'ts' AS "column", min(ts) AS min_date, max(ts) AS max_date, count(ts) AS total_records,
       count(DISTINCT ts) AS unique_dates FROM events
""")
def datetime_stats(spark, sf_dir):
    found = stats.datetime_stats(table(spark, sf_dir, "events"))
    dates = {n: F.col(n).cast("timestamp_ntz") for n in ("min_date", "max_date")}
    return found.withColumns(dates)


@query(f"""
WITH {DIRTY_LINEITEM}
SELECT 'l_shipdate' AS "column", min(l_shipdate) AS min_date, max(l_shipdate) AS max_date,
       count(l_shipdate) AS total_records, count(DISTINCT l_shipdate) AS unique_dates FROM dirty
""")
def datetime_stats_with_missing(spark, sf_dir):
    found = stats.datetime_stats(dirty_lineitem(spark, sf_dir))
    dates = {n: F.col(n).cast("timestamp_ntz") for n in ("min_date", "max_date")}
    return found.withColumns(dates)


def histogram_sql(with_: str, source: str, column: str, bins: int = 10) -> str:
    """Rows counted per bin by comparing with both edges of every bin."""
    return f"""
WITH {with_} vals AS (SELECT CAST({column} AS DOUBLE) AS v FROM {source} WHERE {column} IS NOT NULL),
span AS (
  SELECT CASE WHEN min(v) = max(v) THEN min(v) - CASE WHEN min(v) = 0 THEN 0.001::DOUBLE ELSE abs(min(v)) * 0.001::DOUBLE END
              ELSE min(v) END AS lo,
         CASE WHEN min(v) = max(v) THEN max(v) + CASE WHEN min(v) = 0 THEN 0.001::DOUBLE ELSE abs(min(v)) * 0.001::DOUBLE END
              ELSE max(v) END AS hi,
         min(v) = max(v) AS flat
  FROM vals),
edges AS (
  SELECT CAST(i AS INTEGER) AS bin,
         CASE WHEN i = 1 AND NOT flat THEN lo - (hi - lo) * 0.001::DOUBLE
              ELSE lo + (i - 1) * ((hi - lo) / {bins}) END AS lo,
         CASE WHEN i = {bins} THEN hi ELSE lo + i * ((hi - lo) / {bins}) END AS hi
  FROM span, range(1, {bins + 1}) AS t(i))
SELECT bin, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi,
       count(v) AS count
FROM edges LEFT JOIN vals ON v > lo AND v <= hi GROUP BY bin, lo, hi
"""


def _histogram(df, column, bins=10):
    found = histogram(df, column, bins).drop("label")
    return found.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in ("lo", "hi")})


@query(histogram_sql("", "lineitem", "l_extendedprice"))
def histogram_prices(spark, sf_dir):
    return _histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(histogram_sql(DIRTY_LINEITEM + ",", "dirty", "l_discount"))
def histogram_discounts(spark, sf_dir):
    return _histogram(dirty_lineitem(spark, sf_dir), "l_discount")


@query(histogram_sql("", "orders", "o_totalprice", 200))
def histogram_many_bins(spark, sf_dir):
    return _histogram(table(spark, sf_dir, "orders"), "o_totalprice", 200)


@query(histogram_sql("flat AS (SELECT -5 AS k FROM orders),", "flat", "k"))
def histogram_constant(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(-5).alias("k"))
    return _histogram(orders, "k")


@query(histogram_sql(
    "flags AS (SELECT CAST(value > 100 AS INTEGER) AS high FROM events),", "flags", "high"
))
def histogram_boolean(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("high", F.col("value") > 100)
    return _histogram(events, "high")


def _group_sql(source: str, x: str, expression: str) -> str:
    return (
        f"SELECT {x} AS label, round(CAST({expression} AS DOUBLE), 4) AS value FROM {source} "
        f"WHERE {x} IS NOT NULL GROUP BY {x}"
    )


def _group(df, x, y, aggregation):
    return stats.group_aggregate(df, x, y, aggregation).withColumn("value", F.round("value", 4))


@query(f"WITH {DIRTY_LINEITEM} {_group_sql('dirty', 'l_returnflag', 'avg(l_quantity)')}")
def group_mean(spark, sf_dir):
    return _group(dirty_lineitem(spark, sf_dir), "l_returnflag", "l_quantity", "mean")


@query(f"WITH {DIRTY_LINEITEM} {_group_sql('dirty', 'l_shipdate', 'coalesce(sum(l_quantity), 0)')}")
def group_sum(spark, sf_dir):
    return _group(dirty_lineitem(spark, sf_dir), "l_shipdate", "l_quantity", "sum")


@query(_group_sql("orders", "o_orderdate", "min(o_totalprice)"))
def group_min(spark, sf_dir):
    return _group(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "min")


@query(_group_sql("orders", "o_custkey", "max(o_totalprice)"))
def group_max(spark, sf_dir):
    return _group(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "max")


@query(_group_sql("orders", "o_orderdate", "quantile_cont(o_totalprice, 0.5)"))
def group_median(spark, sf_dir):
    return _group(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "median")


@query(f"""
WITH {DIRTY_LINEITEM}
{_group_sql('dirty', 'l_returnflag', 'quantile_cont(l_extendedprice, 0.5)')}
""")
def group_median_few_groups(spark, sf_dir):
    return _group(dirty_lineitem(spark, sf_dir), "l_returnflag", "l_extendedprice", "median")


HOT_KEY = "CASE WHEN l_orderkey % 5 < 2 THEN 0 ELSE l_orderkey END"


@query(f"""
WITH hot AS (SELECT {HOT_KEY} AS hot, l_extendedprice FROM lineitem)
{_group_sql('hot', 'hot', 'quantile_cont(l_extendedprice, 0.5)')}
""")
def group_median_hot_key(spark, sf_dir):
    """One key has two fifths of the rows."""
    lines = table(spark, sf_dir, "lineitem").select(F.expr(HOT_KEY).alias("hot"), "l_extendedprice")
    return _group(lines, "hot", "l_extendedprice", "median")


@query(f"WITH {DIRTY_LINEITEM} {_group_sql('dirty', 'l_returnflag', 'count(l_quantity)')}")
def group_count(spark, sf_dir):
    return _group(dirty_lineitem(spark, sf_dir), "l_returnflag", "l_quantity", "count")


@query(f"""
WITH {ORDERS_WITH_GAPS}
SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus)
       + max(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) AS labels FROM gaps
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM gaps
UNION ALL SELECT 'o_comment', 1 FROM gaps GROUP BY 2
""")
def distinct_labels(spark, sf_dir):
    columns = ["o_orderstatus", "o_orderpriority", "o_comment"]
    return stats.distinct_labels(orders_with_gaps(spark, sf_dir), columns)
