"""Every query with a SQL twin gives the twin's rows; every other one runs and keeps its schema."""

from __future__ import annotations

import pytest
from conftest import TESTDATA, rows_of, rows_of_sql

from millrace.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows_as_sql(spark, duck, name):
    columns, rows = rows_of(QUERIES[name](spark, TESTDATA))
    expected_columns, expected = rows_of_sql(duck, SQL[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, TESTDATA)
    assert df.columns
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
