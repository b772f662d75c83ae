"""Profile, quality and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.catalog.registry import (
    DIRTY_LINEITEM, LINEITEM_COLUMNS, ORDERS_WITH_GAPS, dirty_lineitem, orders_with_gaps, query,
    table,
)
from sheetwise.operators import profile as profiles
from sheetwise.operators import quality as qualities
from sheetwise.operators.schema import column_classes
from sheetwise.plans import analysis

ORDERS_COLUMNS = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
    "o_comment",
]


def _missing_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS missing, "
        f"round((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) AS missing_pct "
        f"FROM {source}"
        for c in columns
    )


def _quality_sql(columns: list[str], source: str) -> str:
    missing = " + ".join(f"(count(*) - count({c}))" for c in columns)
    some = ", ".join(f"CASE WHEN count({c}) < count(*) THEN '{c}' END" for c in columns)
    none = ", ".join(f"CASE WHEN count({c}) = 0 THEN '{c}' END" for c in columns)
    return f"""
counted AS (
  SELECT count(*) AS total_rows, {missing} AS total_missing_values,
         concat_ws(',', {some}) AS columns_with_missing_values,
         concat_ws(',', {none}) AS empty_columns
  FROM {source}),
copies AS (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM {source})),
percentages AS (
  SELECT *, CAST({len(columns)} AS BIGINT) AS total_columns,
         total_rows - distinct_rows AS duplicated_rows,
         total_missing_values / (greatest(total_rows, 1) * {len(columns)}) * 100 AS missing_pct,
         (total_rows - distinct_rows) / greatest(total_rows, 1) * 100 AS duplicated_pct
  FROM counted, copies),
rated AS (
  SELECT total_rows, total_columns, CAST(total_missing_values AS BIGINT) AS total_missing_values,
         duplicated_rows, columns_with_missing_values, empty_columns,
         round(missing_pct, 2) AS missing_percentage,
         round(duplicated_pct, 2) AS duplicated_percentage,
         round(greatest(0.0, 100 - missing_pct * 1.5 - duplicated_pct * 1.0), 1) AS quality_score,
         total_missing_values > 0 AS has_missing_values,
         duplicated_rows > 0 AS has_duplicates,
         duplicated_rows > 0 OR total_missing_values > 0 OR empty_columns <> '' AS has_problems
  FROM percentages)"""


BAND = "CASE WHEN quality_score >= 90 THEN 'green' WHEN quality_score >= 70 THEN 'yellow' ELSE 'red' END"

DIRTY_RATED = f"WITH {DIRTY_LINEITEM}, {_quality_sql(LINEITEM_COLUMNS, 'dirty')}"
GAPS_RATED = f"WITH {ORDERS_WITH_GAPS}, {_quality_sql(ORDERS_COLUMNS, 'gaps')}"


def _flat(rated):
    """Quality row with its lists as text."""
    return rated.withColumns(
        {
            name: F.array_join(name, ",")
            for name in ("columns_with_missing_values", "empty_columns")
        }
    )


@query(f"WITH {DIRTY_LINEITEM} {_missing_sql(LINEITEM_COLUMNS, 'dirty')}")
def profile_missing(spark, sf_dir):
    found = profiles.profile(dirty_lineitem(spark, sf_dir))
    return found.select("column", "rows", "missing", "missing_pct")


@query("""
SELECT * FROM (VALUES
  (0, 'doc_id', 'bigint', 'numeric'), (1, 'text', 'string', 'categorical'),
  (2, 'lang', 'string', 'categorical'), (3, 'source', 'string', 'categorical'),
  (4, 'n_chars', 'bigint', 'numeric')) AS t(position, "column", type, class)
CROSS JOIN (SELECT count(*) AS "rows" FROM documents)
JOIN (
  SELECT 0 AS position, CAST(8 * count(doc_id) AS BIGINT) AS data_bytes FROM documents UNION ALL
  SELECT 1, CAST(sum(strlen(text)) AS BIGINT) FROM documents UNION ALL
  SELECT 2, CAST(sum(strlen(lang)) AS BIGINT) FROM documents UNION ALL
  SELECT 3, CAST(sum(strlen(source)) AS BIGINT) FROM documents UNION ALL
  SELECT 4, CAST(8 * count(n_chars) AS BIGINT) FROM documents) USING (position)
""")
def profile_types_and_size(spark, sf_dir):
    found = profiles.profile(table(spark, sf_dir, "documents"))
    return found.select("position", "column", "type", "class", "rows", "data_bytes")


@query("""
SELECT count(*) AS total_rows, CAST(3 AS BIGINT) AS total_columns,
       CAST(sum(8 + 4 + 4 * len(embedding)) AS BIGINT) AS data_bytes
FROM embeddings
""")
def dataset_size(spark, sf_dir):
    return profiles.dataset_size(profiles.profile(table(spark, sf_dir, "embeddings")))


@query(f"{DIRTY_RATED} SELECT *, {BAND} AS band FROM rated")
def quality_score(spark, sf_dir):
    return _flat(qualities.quality(dirty_lineitem(spark, sf_dir)))


@query(f"{GAPS_RATED} SELECT *, {BAND} AS band FROM rated")
def quality_of_orders(spark, sf_dir):
    return _flat(qualities.quality(orders_with_gaps(spark, sf_dir)))


@query("""
WITH copies AS (SELECT text, lang FROM documents)
SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM copies))
       AS duplicated_rows FROM copies
""")
def duplicate_texts(spark, sf_dir):
    """Copies among long texts: the shuffle carries digests, not the texts."""
    texts = table(spark, sf_dir, "documents").select("text", "lang")
    return qualities.quality(texts).select("total_rows", "duplicated_rows")


@query(f"""
WITH {DIRTY_LINEITEM}, found AS ({_missing_sql(LINEITEM_COLUMNS, 'dirty')})
SELECT "column" FROM found WHERE missing > 0
""")
def missing_columns(spark, sf_dir):
    rated = qualities.quality(dirty_lineitem(spark, sf_dir))
    return rated.select(F.explode("columns_with_missing_values").alias("column"))


@query(f"""
WITH {ORDERS_WITH_GAPS}, found AS ({_missing_sql(ORDERS_COLUMNS, 'gaps')})
SELECT "column" FROM found WHERE missing = "rows"
""")
def empty_columns(spark, sf_dir):
    rated = qualities.quality(orders_with_gaps(spark, sf_dir))
    return rated.select(F.explode("empty_columns").alias("column"))


@query(f"""{DIRTY_RATED}
SELECT total_columns, 8 AS numeric_columns, 2 AS categorical_columns, 1 AS datetime_columns,
       0 AS boolean_columns, has_missing_values, has_duplicates, quality_score FROM rated
""")
def dataset_summary(spark, sf_dir):
    return qualities.dataset_summary(dirty_lineitem(spark, sf_dir))


RULES = """
fired AS (
  SELECT 'good_condition' AS rule, 'ok' AS severity,
         'The dataset is in good condition; no transformation is recommended.' AS message,
         NOT has_problems AS fires FROM rated
  UNION ALL SELECT 'remove_duplicates', 'error',
         duplicated_rows || ' duplicated rows; consider removing them.',
         duplicated_rows > 0 FROM rated
  UNION ALL SELECT 'handle_missing', 'warning',
         total_missing_values || ' missing values; consider dropping or filling them.',
         total_missing_values > 0 FROM rated
  UNION ALL SELECT 'columns_with_missing', 'info',
         'Columns with missing values: ' || replace(columns_with_missing_values, ',', ', '),
         columns_with_missing_values <> '' FROM rated
  UNION ALL SELECT 'improve_quality', 'warning',
         'The quality can improve; current score ' || quality_score || '/100.',
         has_problems AND quality_score < 90 FROM rated)
SELECT rule, severity, message FROM fired WHERE fires"""


@query(f"{DIRTY_RATED}, {RULES}")
def recommendations(spark, sf_dir):
    return qualities.recommendations(qualities.quality(dirty_lineitem(spark, sf_dir)))


CLEAN_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(f"WITH {_quality_sql(CLEAN_COLUMNS, 'customer')}, {RULES}")
def warnings_clean_table(spark, sf_dir):
    return analysis.warnings(table(spark, sf_dir, "customer"))


@query("""
SELECT class, total, columns, missing FROM (VALUES
  ('numeric', 3, 'event_id,user_id,value',
   (SELECT 3 * count(*) - count(event_id) - count(user_id) - count(value) FROM events)),
  ('categorical', 2, 'event_type,props', (SELECT 2 * count(*) - count(event_type) - count(props) FROM events)),
  ('datetime', 1, 'ts', (SELECT count(*) - count(ts) FROM events)),
  ('boolean', 1, 'high', (SELECT count(*) FROM events WHERE value <= 100 OR value IS NULL)))
  AS t(class, total, columns, missing)
""")
def column_classes_of_events(spark, sf_dir):
    """Columns of each class, and how many of their cells are missing."""
    high = F.when(F.col("value") > 100, F.lit(True))
    events = table(spark, sf_dir, "events").withColumn("high", high)
    missing = profiles.profile(events).groupBy("class").agg(F.sum("missing").alias("missing"))
    return column_classes(events).withColumn("columns", F.array_join("columns", ",")).join(missing, "class")


@query(f"""{DIRTY_RATED}
SELECT unnest(['total_rows', 'total_columns', 'quality_score', 'numeric_columns',
               'categorical_columns']) AS kpi,
       unnest([CAST(total_rows AS VARCHAR), CAST(total_columns AS VARCHAR),
               quality_score || '/100', '8', '2']) AS value
FROM rated
""")
def kpi_table(spark, sf_dir):
    return analysis.kpi_table(dirty_lineitem(spark, sf_dir))


@query(f"""{DIRTY_RATED},
size AS (
  SELECT sum(8 + 8 + 8 + 4 + CASE WHEN l_quantity IS NULL THEN 0 ELSE 8 END + 8
             + CASE WHEN l_discount IS NULL THEN 0 ELSE 8 END + 8
             + coalesce(strlen(l_returnflag), 0) + strlen(l_linestatus)
             + CASE WHEN l_shipdate IS NULL THEN 0 ELSE 8 END) AS data_bytes FROM dirty)
SELECT unnest(['total_rows', 'total_columns', 'quality_score', 'data_bytes']) AS kpi,
       unnest([CAST(total_rows AS VARCHAR), CAST(total_columns AS VARCHAR),
               quality_score || '/100', CAST(data_bytes AS VARCHAR)]) AS value
FROM rated, size
""")
def kpi_cards(spark, sf_dir):
    return analysis.kpi_cards(dirty_lineitem(spark, sf_dir))
