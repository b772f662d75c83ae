"""Cleaning operators and cleaning runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.catalog.registry import (
    DIRTY_LINEITEM, LINEITEM_COLUMNS, NOISY_PART, TITLE_CASE, dirty_lineitem, noisy_part,
    orders_with_gaps, query, table,
)
from sheetwise.functions.columns import ROW_ID
from sheetwise.operators import cleaning
from sheetwise.plans import cleaning_run
from sheetwise.session import scratch_path
from sheetwise.sources.readers import read_table

ALL_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in LINEITEM_COLUMNS)


@query(f"WITH {DIRTY_LINEITEM} SELECT DISTINCT * FROM dirty")
def remove_duplicates(spark, sf_dir):
    return cleaning.remove_duplicates(dirty_lineitem(spark, sf_dir))


@query("""
SELECT l_returnflag, l_linenumber, l_quantity, min(place) - 1 AS first_row
FROM (SELECT *, row_number() OVER () AS place FROM lineitem)
GROUP BY l_returnflag, l_linenumber, l_quantity
""")
def remove_duplicates_in_file_order(spark, sf_dir):
    """Of equal rows the first in the file is kept."""
    lines = read_table(spark, f"{sf_dir}/lineitem.parquet", row_id=True)
    kept = cleaning.remove_duplicates(lines.select("l_returnflag", "l_linenumber", "l_quantity", ROW_ID))
    return kept.withColumn("first_row", F.col(ROW_ID)["row"]).drop(ROW_ID)


@query(f"WITH {DIRTY_LINEITEM} SELECT * FROM dirty WHERE {ALL_PRESENT}")
def remove_missing_values(spark, sf_dir):
    return cleaning.remove_missing_values(dirty_lineitem(spark, sf_dir))


@query("""
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders
""")
def convert_column_types(spark, sf_dir):
    dated = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", dated)
    return cleaning.convert_column_types(
        orders,
        {
            "o_orderdate": "datetime64[ns]",
            "o_totalprice": "int64",
            "o_custkey": "str",
            "unknown": "int64",
        },
    )


@query(f"""
WITH {NOISY_PART}
SELECT p_partkey, {TITLE_CASE.format("p_name")} AS p_name, {TITLE_CASE.format("p_brand")} AS p_brand,
       p_type, p_size, p_retailprice
FROM noisy
""")
def normalize_text(spark, sf_dir):
    return cleaning.normalize_text(noisy_part(spark, sf_dir), ["p_name", "p_brand", "unknown"])


@query("""
SELECT c_custkey AS id, c_name AS "full name", c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def rename_columns(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return cleaning.rename_columns(
        customers, {"c_custkey": "id", "c_name": "full name", "unknown": "x"}
    )


@query("SELECT * FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment IN ('MACHINERY', 'FURNITURE')")
def filter_rows(spark, sf_dir):
    return cleaning.filter_rows(
        table(spark, sf_dir, "customer"),
        "c_acctbal >= 1000 and c_mktsegment in ('MACHINERY', 'FURNITURE')",
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus
FROM orders WHERE o_orderstatus <> 'F'
""")
def filter_keeps_missing(spark, sf_dir):
    kept = cleaning.filter_rows(orders_with_gaps(spark, sf_dir), "not (o_orderstatus <=> 'F')")
    return kept.select("o_orderkey", "o_orderstatus")


STEPS = [
    {"operation": "remove_duplicates"},
    {"operation": "remove_missing_values", "params": {}},
    {"operation": "convert_column_types", "params": {"column_types": {"p_retailprice": "int64"}}},
    {"operation": "normalize_text", "params": {"columns": ["p_name"]}},
    {"operation": "rename_columns", "params": {"column_mapping": {"p_brand": "brand"}}},
    {"operation": "filter_rows", "params": {"query": "p_size >= 10 and brand <> 'Brand#1'"}},
]

CLEANED = f"""
{NOISY_PART},
cleaned AS (
  SELECT p_partkey, {TITLE_CASE.format("p_name")} AS p_name, p_brand AS brand, p_type, p_size,
         CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice
  FROM (SELECT DISTINCT * FROM noisy)
  WHERE p_brand IS NOT NULL AND p_size >= 10 AND p_brand <> 'Brand#1')"""


@query(f"WITH {CLEANED} SELECT * FROM cleaned")
def cleaning_steps(spark, sf_dir):
    return cleaning_run.apply_steps(noisy_part(spark, sf_dir), STEPS)


@query(f"""
WITH {CLEANED}, before AS (SELECT count(*) AS n FROM noisy), after AS (SELECT count(*) AS m FROM cleaned)
SELECT n AS original_rows, m AS resulting_rows, n - m AS removed_rows,
       'remove_duplicates,remove_missing_values,convert_column_types,normalize_text,rename_columns,filter_rows'
       AS operations
FROM before, after
""")
def cleaning_preview(spark, sf_dir):
    previewed = cleaning_run.preview_steps(noisy_part(spark, sf_dir), STEPS)
    return previewed.withColumn("operations", F.array_join("operations", ","))


@query(f"""
WITH {CLEANED}, before AS (SELECT count(*) AS n FROM noisy), after AS (SELECT count(*) AS m FROM cleaned)
SELECT n AS original_rows, m AS resulting_rows, 6 AS resulting_columns,
       'Cleaning finished. ' || n || ' -> ' || m || ' rows.' AS message
FROM before, after
""")
def cleaning_report(spark, sf_dir):
    source = scratch_path(spark, "part.csv")
    _, report = cleaning_run.run_steps(noisy_part(spark, sf_dir), STEPS, source)
    return report


@query(f"WITH {CLEANED} SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM cleaned")
def clean_copy_read_back(spark, sf_dir):
    source = scratch_path(spark, "part.csv")
    path, _ = cleaning_run.run_steps(noisy_part(spark, sf_dir), STEPS, source)
    return read_table(spark, path)
