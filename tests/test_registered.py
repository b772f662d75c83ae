"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, SF) is None


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["total_rows"] > 6000 and row["band"] in ("green", "yellow", "red")


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
