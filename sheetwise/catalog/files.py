"""CSV reading and writing, type inference, date detection, registry.

These write a copy of a whole table under the shared folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.catalog.registry import query, table
from sheetwise.session import scratch_path
from sheetwise.sources import registry
from sheetwise.sources.inference import detect_dates
from sheetwise.sources.readers import read_csv, read_table
from sheetwise.sources.writers import write_table


@query("SELECT * FROM events")
def csv_roundtrip(spark, sf_dir):
    """Types, quotes and fractions of a second survive CSV."""
    path = write_table(table(spark, sf_dir, "events"), scratch_path(spark, "events.csv"))
    return read_table(spark, path)


@query("SELECT * FROM documents")
def csv_roundtrip_whole_texts(spark, sf_dir):
    """Texts with line breaks survive CSV."""
    path = write_table(table(spark, sf_dir, "documents"), scratch_path(spark, "documents.csv"))
    return read_table(spark, path, multi_line=True)


@query("SELECT * FROM documents")
def csv_quoted_breaks(spark, sf_dir):
    """Line breaks inside quotes are found without being told of."""
    path = write_table(table(spark, sf_dir, "documents"), scratch_path(spark, "documents.csv"))
    return read_table(spark, path)


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice,
       CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS o_orderpriority
FROM orders
""")
def csv_short_rows(spark, sf_dir):
    """Rows that end before the last column."""
    cells = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    texts = [F.col(c).cast("string") for c in cells]
    line = (
        F.when(F.col("o_orderstatus") == "F", F.concat_ws(",", *texts[:2]))
        .when(F.col("o_orderstatus") == "O", F.concat_ws(",", *texts))
        .otherwise(F.concat_ws(",", *texts[:3]))
    )
    path = scratch_path(spark, "orders.csv")
    lines = table(spark, sf_dir, "orders").select(line.alias(",".join(cells)))
    lines.write.csv(path, header=True, sep="\x01", quote="")
    return read_table(spark, path)


@query("""
SELECT o_orderkey,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS o_custkey,
       CAST(CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS DOUBLE) AS o_totalprice,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'O' END AS is_open,
       CASE WHEN o_orderstatus = 'O' THEN '1d' ELSE '2f' END AS suffixed,
       CASE WHEN o_orderkey > 100 THEN 'word' ELSE CAST(o_orderkey AS VARCHAR) END AS mixed,
       CAST(NULL AS DOUBLE) AS nothing
FROM orders
""")
def type_inference(spark, sf_dir):
    """Integers, doubles, booleans and text with NA tokens among them."""
    orders = table(spark, sf_dir, "orders")
    texts = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string"))
        .otherwise("NA")
        .alias("o_custkey"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice").cast("string"))
        .otherwise("n/a")
        .alias("o_totalprice"),
        F.when(F.col("o_orderstatus") == "O", "True")
        .when(F.col("o_orderstatus") == "F", "FALSE")
        .otherwise("")
        .alias("is_open"),
        F.when(F.col("o_orderstatus") == "O", "1d").otherwise("2f").alias("suffixed"),
        F.when(F.col("o_orderkey") > 100, "word")
        .otherwise(F.col("o_orderkey").cast("string"))
        .alias("mixed"),
        F.lit("null").alias("nothing"),
    )
    path = write_table(texts, scratch_path(spark, "orders.csv"))
    return read_table(spark, path)


@query("""
SELECT o_orderkey,
       CASE WHEN o_totalprice >= 10000 THEN o_orderdate END AS month_first,
       o_orderdate AS day_first, o_orderdate AS minutes, o_orderdate AS zoned,
       o_orderdate AS month_first_time, o_orderdate AS month_name, o_orderdate AS free_form,
       CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'later' END AS too_few
FROM orders
""")
def date_detection(spark, sf_dir):
    """Dates in different formats; a few bad values become missing, many keep the text."""
    orders = table(spark, sf_dir, "orders")
    return detect_dates(
        orders.select(
            "o_orderkey",
            F.when(F.col("o_totalprice") >= 10000, F.date_format("o_orderdate", "M/d/yyyy"))
            .otherwise("unknown")
            .alias("month_first"),
            F.date_format("o_orderdate", "d-M-yyyy").alias("day_first"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("minutes"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("zoned"),
            F.date_format("o_orderdate", "M/d/yyyy H:mm:ss").alias("month_first_time"),
            F.date_format("o_orderdate", "dd-MMM-yyyy").alias("month_name"),
            F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MMMM d, yyyy"))
            .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "d MMM yyyy HH:mm"))
            .otherwise(F.date_format("o_orderdate", "EEEE, MMM d yyyy h:mm:ss a"))
            .alias("free_form"),
            F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
            .otherwise("later")
            .alias("too_few"),
        )
    )


@query("SELECT * FROM customer")
def csv_with_known_types(spark, sf_dir):
    """A schema makes the second pass over the text unnecessary."""
    customers = table(spark, sf_dir, "customer")
    path = write_table(customers, scratch_path(spark, "customer.csv"))
    return read_csv(spark, path, schema=customers.schema)


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS name, '{name}.parquet' AS original_filename, '.parquet' AS file_type, "
    f"count(*) AS total_rows FROM {name}"
    for name in TABLES
))
def registry_tables(spark, sf_dir):
    """Every table that the registry lists in the folder, with its rows."""
    listed = registry.datasets(spark, sf_dir).join(registry.row_counts(spark, sf_dir), "file_path", "left")
    rows = F.coalesce("total_rows", F.lit(0)).alias("total_rows")
    return listed.orderBy("file_path").select("name", "original_filename", "file_type", rows)


@query("SELECT * FROM customer WHERE c_name = 'Customer#000000042' ORDER BY c_custkey LIMIT 1")
def first_match(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return registry.first_match(customers, "c_name", "Customer#000000042", "c_custkey")
