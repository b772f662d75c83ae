"""Table views: search, sort, page, records, first rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.catalog.registry import (
    DIRTY_LINEITEM, ORDERS_WITH_GAPS, dirty_lineitem, orders_with_gaps, query, table,
)
from sheetwise.operators import table as views
from sheetwise.operators.profile import first_rows
from sheetwise.sources.readers import read_head, read_table


@query("""
SELECT * FROM part
WHERE regexp_matches(p_name, '^(BLUE|hot).*T$', 'i') OR regexp_matches(p_brand, '^(BLUE|hot).*T$', 'i')
   OR regexp_matches(p_type, '^(BLUE|hot).*T$', 'i')
""")
def search(spark, sf_dir):
    return views.search(table(spark, sf_dir, "part"), "^(BLUE|hot).*T$")


@query("SELECT * FROM documents WHERE regexp_matches(text, 'é.*\\n', 'i') OR regexp_matches(lang, 'é.*\\n', 'i') OR regexp_matches(source, 'é.*\\n', 'i')")
def search_whole_texts(spark, sf_dir):
    return views.search(table(spark, sf_dir, "documents"), r"é.*\n")


@query("SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 50")
def sorted_page(spark, sf_dir):
    return views.page(table(spark, sf_dir, "customer"), 2, 50, "c_acctbal", "DESC")


@query(f"""
WITH {ORDERS_WITH_GAPS}
SELECT * FROM gaps ORDER BY o_orderstatus NULLS LAST, o_orderkey LIMIT 100 OFFSET 9900
""")
def page_with_missing_last(spark, sf_dir):
    page = views.page(orders_with_gaps(spark, sf_dir), 100, 100, "o_orderstatus")
    return page


@query(f"""
WITH {DIRTY_LINEITEM}
SELECT * FROM dirty
ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey NULLS LAST, l_partkey NULLS LAST,
  l_suppkey NULLS LAST, l_linenumber NULLS LAST, l_quantity NULLS LAST, l_discount NULLS LAST,
  l_tax NULLS LAST, l_returnflag NULLS LAST, l_linestatus NULLS LAST, l_shipdate NULLS LAST
LIMIT 1000 OFFSET (SELECT (count(*) * 9 // 10) // 1000 * 1000 FROM dirty)
""")
def deep_page(spark, sf_dir):
    """A page after nine tenths of the rows."""
    lines = dirty_lineitem(spark, sf_dir)
    total = lines.count()
    return views.page(lines, total * 9 // 10 // 1000 + 1, 1000, "l_extendedprice", "desc", total_rows=total)


@query("""
SELECT o_orderstatus, CAST(o_orderkey AS VARCHAR) AS order_key, o_orderpriority AS priority
FROM orders ORDER BY o_orderstatus, order_key, priority
LIMIT 100 OFFSET (SELECT (count(*) // 2) // 100 * 100 FROM orders)
""")
def deep_page_with_map(spark, sf_dir):
    """A page amid thousands of rows that differ in a map alone."""
    entries = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("key"), F.col("o_orderkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", entries.alias("more"))
    number = orders.count() // 2 // 100 + 1
    found = views.page(orders, number, 100, "o_orderstatus")
    return found.select("o_orderstatus", F.col("more")["key"].alias("order_key"), F.col("more")["priority"].alias("priority"))


@query("""
WITH ranked AS (SELECT * FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey)
SELECT * FROM ranked LIMIT 100 OFFSET 100
""")
def next_page(spark, sf_dir):
    """The page after the last row of page one."""
    orders = table(spark, sf_dir, "orders")
    last = views.page(orders, 1, 100, "o_totalprice").collect()[-1].asDict()
    return views.page_after(orders, last, 100, "o_totalprice")


@query("""
SELECT count(*) AS total_rows,
       count(*) FILTER (WHERE regexp_matches(c_name, '9.*1', 'i') OR regexp_matches(c_mktsegment, '9.*1', 'i'))
         AS filtered_rows,
       1 AS page, 50 AS page_size,
       greatest(1, CAST(ceil(count(*) FILTER (WHERE regexp_matches(c_name, '9.*1', 'i') OR regexp_matches(c_mktsegment, '9.*1', 'i')) / 50) AS BIGINT))
         AS total_pages
FROM customer
""")
def page_info(spark, sf_dir):
    return views.page_info(table(spark, sf_dir, "customer"), "9.*1")


@query(f"""
WITH {ORDERS_WITH_GAPS}
SELECT CAST(to_json({{'o_orderkey': o_orderkey, 'o_custkey': o_custkey,
  'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice,
  'o_orderdate': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'),
  'o_orderpriority': o_orderpriority, 'o_comment': o_comment}}) AS VARCHAR) AS record
FROM gaps
""")
def records_json(spark, sf_dir):
    return views.records(orders_with_gaps(spark, sf_dir))


@query("""
SELECT CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey,
  'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment}) AS VARCHAR) AS record
FROM (SELECT * FROM customer
      WHERE regexp_matches(c_name, '7$', 'i') OR regexp_matches(c_mktsegment, '7$', 'i')
      ORDER BY c_nationkey DESC, c_custkey LIMIT 50 OFFSET 50)
""")
def table_view(spark, sf_dir):
    found = views.table_view(
        table(spark, sf_dir, "customer"), 2, 50, "c_nationkey", "desc", pattern="7$"
    )
    return found["records"]


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, sf_dir):
    """First five rows in file order."""
    return first_rows(read_table(spark, f"{sf_dir}/orders.parquet", row_id=True))


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def sample(spark, sf_dir):
    """First twenty rows in file order, reading only the files that hold them."""
    return read_head(spark, f"{sf_dir}/customer.parquet", 20)
