"""Context document and chat history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sheetwise.catalog.registry import orders_with_gaps, query, table
from sheetwise.plans import analysis
from sheetwise.sources.readers import read_head, read_table


ORDER_COLUMNS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
ORDER_NUMBERS = [c for c, kind in ORDER_COLUMNS.items() if kind in ("bigint", "double")]
ORDER_TEXTS = [c for c, kind in ORDER_COLUMNS.items() if kind == "string"]
CONTEXT = """total_rows bigint, total_columns int, column_names array<string>,
    column_types array<struct<column:string,type:string>>,
    numeric_statistics array<struct<column:string,mean:double,median:double,min:double,max:double,std:double>>,
    missing_values array<struct<column:string,missing:bigint,missing_pct:double>>,
    correlation_matrix array<struct<col_a:string,col_b:string,corr:double>>,
    top_categories array<struct<column:string,label:string,count:bigint>>, sample array<string>"""


def _row(part: str, key: str, field: str, number: str, text: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT '{part}' AS part, {key} AS key, {field} AS field, CAST({number} AS DOUBLE) AS number, {text} AS text"


def _context_rows() -> str:
    rows = [
        _row("total_rows", "''", "''", "(SELECT count(*) FROM orders)"),
        _row("total_columns", "''", "''", "6"),
    ]
    for i, (name, kind) in enumerate(ORDER_COLUMNS.items()):
        rows.append(_row("column_names", f"'{i}'", "''", "NULL", f"'{name}'"))
        rows.append(_row("column_types", f"'{name}'", "''", "NULL", f"'{kind}'"))
        rows.append(_row("missing_values", f"'{name}'", "'missing'", f"count(*) - count({name})") + " FROM orders")
        pct = f"round((count(*) - count({name})) / greatest(count(*), 1) * 100, 2)"
        rows.append(_row("missing_values", f"'{name}'", "'missing_pct'", pct) + " FROM orders")
    for name in ORDER_NUMBERS:
        values = {
            "mean": f"avg({name})", "median": f"quantile_cont(CAST({name} AS DOUBLE), 0.5)", "min": f"min({name})",
            "max": f"max({name})", "std": f"stddev_samp({name})",
        }
        for field, value in values.items():
            rows.append(_row("numeric_statistics", f"'{name}'", f"'{field}'", f"round({value}, 2)") + " FROM orders")
        for other in ORDER_NUMBERS:
            rows.append(_row("correlation_matrix", f"'{name}'", f"'{other}'", f"round(corr({name}, {other}), 6) + 0.0") + " FROM orders")
    for name in ORDER_TEXTS:
        top = f"(SELECT {name} AS label, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"
        rows.append(_row("top_categories", f"'{name}'", "label", "n") + f" FROM {top}")
    sample = "(SELECT *, row_number() OVER () AS place FROM orders LIMIT 20)"
    rows.append(_row("sample", "CAST(place - 1 AS VARCHAR)", "o_orderstatus", "o_orderkey", "o_orderpriority") + f" FROM {sample}")
    return " UNION ALL ".join(rows)


@query(_context_rows())
def context_json(spark, sf_dir):
    """The JSON context of a table, every value of it as a row."""
    path = f"{sf_dir}/orders.parquet"
    written = analysis.context_json(read_table(spark, path), read_head(spark, path, 20))
    c = written.select(F.from_json("context", CONTEXT).alias("c")).select("c.*")
    none, no_text = F.lit(""), F.lit(None).cast("string")

    def entry(part, key, field, number=None, text=no_text):
        number = F.lit(None).cast("double") if number is None else number.cast("double")
        return F.struct(
            F.lit(part).alias("part"), key.alias("key"), field.alias("field"), number.alias("number"), text.alias("text")
        )

    def fields(part, *names):
        return F.flatten(F.transform(part, lambda r: F.array(*[entry(part, r["column"], F.lit(n), r[n]) for n in names])))

    rows = F.concat(
        F.array(entry("total_rows", none, none, F.col("total_rows")), entry("total_columns", none, none, F.col("total_columns"))),
        F.transform("column_names", lambda n, i: entry("column_names", i.cast("string"), none, None, n)),
        F.transform("column_types", lambda r: entry("column_types", r["column"], none, None, r["type"])),
        fields("missing_values", "missing", "missing_pct"),
        fields("numeric_statistics", "mean", "median", "min", "max", "std"),
        F.transform("correlation_matrix", lambda r: entry("correlation_matrix", r["col_a"], r["col_b"], F.round(r["corr"], 6) + F.lit(0.0))),
        F.transform("top_categories", lambda r: entry("top_categories", r["column"], r["label"], r["count"])),
        F.transform(
            "sample",
            lambda r, i: entry(
                "sample", i.cast("string"), F.get_json_object(r, "$.o_orderstatus"),
                F.get_json_object(r, "$.o_orderkey").cast("bigint"), F.get_json_object(r, "$.o_orderpriority"),
            ),
        ),
    )
    return c.select(F.inline(rows))


@query("""
WITH status AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s FROM orders)
SELECT count(*) AS total_rows, 7 AS total_columns,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority,o_comment'
         AS column_names,
       (SELECT round(avg(o_totalprice), 2) FROM orders) AS mean_price,
       (SELECT round(quantile_cont(o_totalprice, 0.5), 2) FROM orders) AS median_price,
       count(*) - count(s) AS missing_status,
       round((count(*) - count(s)) / greatest(count(*), 1) * 100, 2) AS missing_status_pct,
       9 AS correlations,
       1 + (SELECT least(10, count(*)) FROM (SELECT DISTINCT s FROM status))
         + (SELECT least(10, count(DISTINCT o_orderpriority)) FROM orders) AS top_labels,
       least(20, count(*)) AS sample_rows
FROM status
""")
def context_figures(spark, sf_dir):
    """Figures picked from every part of the context."""
    context = analysis.build_context(orders_with_gaps(spark, sf_dir))
    price = F.filter("numeric_statistics", lambda s: s["column"] == "o_totalprice")[0]
    status = F.filter("missing_values", lambda s: s["column"] == "o_orderstatus")[0]
    return context.select(
        "total_rows",
        "total_columns",
        F.array_join("column_names", ",").alias("column_names"),
        price["mean"].alias("mean_price"),
        price["median"].alias("median_price"),
        status["missing"].alias("missing_status"),
        status["missing_pct"].alias("missing_status_pct"),
        F.size("correlation_matrix").alias("correlations"),
        F.size("top_categories").cast("bigint").alias("top_labels"),
        F.size("sample").cast("bigint").alias("sample_rows"),
    )


@query("""
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
WHERE r <= 6
""")
def last_turns(spark, sf_dir):
    return analysis.last_turns(table(spark, sf_dir, "conversations"))


CUSTOMER_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]


def _analysis_rows() -> str:
    rows = [
        _row("columns", "class", "columns", "total") + """ FROM (VALUES ('numeric', 3, 'c_custkey,c_nationkey,c_acctbal'),
            ('categorical', 2, 'c_name,c_mktsegment'), ('datetime', 0, ''), ('boolean', 0, '')) AS t(class, total, columns)""",
    ]
    for name in ("c_name", "c_mktsegment"):
        rows.append(_row("categorical_statistics", f"'{name}'", name, "count(*)") + f" FROM customer GROUP BY {name}")
    for name in CUSTOMER_NUMBERS:
        values = {
            "count": f"count({name})", "min": f"min({name})", "max": f"max({name})", "mean": f"round(avg({name}), 2)",
            "median": f"round(quantile_cont(CAST({name} AS DOUBLE), 0.5), 4)", "std": f"round(stddev_samp({name}), 2)",
            "q1": f"round(quantile_cont(CAST({name} AS DOUBLE), 0.25), 4)",
            "q3": f"round(quantile_cont(CAST({name} AS DOUBLE), 0.75), 4)", "sum": f"round(sum(CAST({name} AS DOUBLE)), 2)",
        }
        for field, value in values.items():
            rows.append(_row("numeric_statistics", f"'{name}'", f"'{field}'", value) + " FROM customer")
        for other in CUSTOMER_NUMBERS:
            rows.append(_row("correlation_matrix", f"'{name}'", f"'{other}'", f"round(corr({name}, {other}), 6) + 0.0") + " FROM customer")
    cells = " + ".join(f"count({c})" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    rated = f"""(SELECT (5 * count(*) - ({cells})) AS missing, count(*) AS n,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS copies FROM customer)"""
    score = "round(greatest(0, 100 - missing / (greatest(n, 1) * 5) * 100 * 1.5 - copies / greatest(n, 1) * 100), 1)"
    rows.append(_row("dataset_summary", "''", "'quality_score'", score) + f" FROM {rated}")
    rows.append(_row("dataset_summary", "''", "'total_columns'", "5"))
    return " UNION ALL ".join(rows)


@query(_analysis_rows())
def analyze(spark, sf_dir):
    """Every value of the analysis as a row."""
    parts = analysis.analyze(table(spark, sf_dir, "customer"))

    def long(frame, part, key, field, number):
        return frame.select(
            F.lit(part).alias("part"), key.alias("key"), field.alias("field"), number.cast("double").alias("number"),
            F.lit(None).cast("string").alias("text"),
        )

    def unpivoted(frame, part, key, names):
        values = F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).cast("double").alias("v")) for n in names])
        return long(frame.select(key.alias("k"), F.inline(values)), part, F.col("k"), F.col("f"), F.col("v"))

    numbers = parts["numeric_statistics"].withColumns(
        {n: F.round(n, 4) for n in ("median", "q1", "q3")} | {"sum": F.round("sum", 2)}
    )
    found = [
        long(parts["columns"], "columns", F.col("class"), F.array_join("columns", ","), F.col("total")),
        long(parts["categorical_statistics"], "categorical_statistics", F.col("column"), F.col("label"), F.col("count")),
        unpivoted(numbers, "numeric_statistics", F.col("column"), ["count", "min", "max", "mean", "median", "std", "q1", "q3", "sum"]),
        long(parts["correlation_matrix"], "correlation_matrix", F.col("col_a"), F.col("col_b"), F.round("corr", 6) + F.lit(0.0)),
        long(parts["datetime_statistics"], "datetime_statistics", F.col("column"), F.lit("total_records"), F.col("total_records")),
        unpivoted(parts["dataset_summary"], "dataset_summary", F.lit(""), ["quality_score", "total_columns"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), found)
