"""Query registry and the tables that the queries read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with the SQL that gives the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The given tables have no missing values and no duplicate rows. These variants plant both:
# gaps by value, and a second copy of every row with line status F (half of the table).

LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    marked = lines.withColumns(
        {
            "l_quantity": F.when(F.col("l_tax") != 0, F.col("l_quantity")),
            "l_discount": F.when(F.col("l_linenumber") != 7, F.col("l_discount")),
            "l_returnflag": F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")),
            "l_shipdate": F.when(F.col("l_quantity") < 50, F.col("l_shipdate")),
        }
    )
    return marked.unionAll(marked.filter("l_linestatus = 'F'"))


DIRTY_LINEITEM = """
marked AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_tax <> 0 THEN l_quantity END AS l_quantity,
         l_extendedprice,
         CASE WHEN l_linenumber <> 7 THEN l_discount END AS l_discount,
         l_tax,
         CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS l_returnflag,
         l_linestatus,
         CASE WHEN l_quantity < 50 THEN l_shipdate END AS l_shipdate
  FROM lineitem),
dirty AS (SELECT * FROM marked UNION ALL SELECT * FROM marked WHERE l_linestatus = 'F')
"""


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an empty column and unknown status for status P."""
    orders = table(spark, sf_dir, "orders")
    return orders.withColumns(
        {
            "o_orderstatus": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
            "o_comment": F.lit(None).cast("string"),
        }
    )


ORDERS_WITH_GAPS = """
gaps AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus,
         o_totalprice, o_orderdate, o_orderpriority, CAST(NULL AS VARCHAR) AS o_comment
  FROM orders)
"""


def noisy_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names have blanks, odd case and punctuation; small ones have no brand."""
    parts = table(spark, sf_dir, "part")
    name = F.when(
        F.col("p_size") < 25, F.concat(F.lit("  o'"), F.upper("p_name"), F.lit("-x9y\t"))
    ).otherwise(F.concat(F.lit("á "), F.col("p_name"), F.lit(" ")))
    brand = F.when(F.col("p_size") > 3, F.col("p_brand"))
    marked = parts.withColumns({"p_name": name, "p_brand": brand})
    return marked.unionAll(marked.filter("p_type = 'SMALL'"))


NOISY_PART = """
marked AS (
  SELECT p_partkey,
         CASE WHEN p_size < 25 THEN '  o''' || upper(p_name) || '-x9y' || chr(9)
              ELSE 'á ' || p_name || ' ' END AS p_name,
         CASE WHEN p_size > 3 THEN p_brand END AS p_brand,
         p_type, p_size, p_retailprice
  FROM part),
noisy AS (SELECT * FROM marked UNION ALL SELECT * FROM marked WHERE p_type = 'SMALL')
"""

TITLE_CASE = (
    r"array_to_string(list_transform(regexp_extract_all(lower(regexp_replace(regexp_replace("
    r"{0}, '^\s+', ''), '\s+$', '')), '\p{{L}}+|[^\p{{L}}]+'), "
    r"lambda r: upper(r[1]) || r[2:]), '')"
)
