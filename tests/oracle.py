"""Compare registered queries with their SQL, strictly: names, kinds of type, values.

    python -m tests.oracle [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb
from pyspark.sql import types as T

import __spark_entry__ as entry
from sheetwise.session import local_session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SPARK_KINDS = [
    (T.BooleanType, "boolean"), (T.IntegerType, "int"), (T.LongType, "bigint"),
    (T.DoubleType, "double"),
    (T.StringType, "text"), (T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp"),
    (T.ArrayType, "list"),
]
DUCK_KINDS = {
    "BOOLEAN": "boolean", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double",
    "VARCHAR": "text", "TIMESTAMP": "timestamp",
}


def connect(sf_dir: str):
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return duck


def _value(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, duck, name: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    found = entry.queries()[name](spark, sf_dir)
    kinds = {
        f.name: next((k for t, k in SPARK_KINDS if isinstance(f.dataType, t)), str(f.dataType))
        for f in found.schema.fields
    }
    rows = _rows(found.columns, found.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if rows else "no rows"
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    wanted_kinds = {
        d[0]: DUCK_KINDS.get(str(d[1]), "list" if str(d[1]).endswith("]") else str(d[1]))
        for d in result.description
    }
    wanted = _rows(names, result.fetchall())
    if kinds != wanted_kinds:
        return f"types {sorted(kinds.items())} / {sorted(wanted_kinds.items())}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows / {len(wanted)} rows"
    different = [(a, b) for a, b in zip(rows, wanted, strict=True) if a != b]
    return f"{len(different)} rows differ: {different[:2]}" if different else None


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    duck = connect(sf_dir)
    bad = 0
    for name in names or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, duck, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        oracle = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name}{oracle} {problem or ''}"[:1200], flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
