"""Every registered query equals its SQL counterpart on another engine."""

import compare
import pytest

from __spark_entry__ import entry
from tarmac.checks.oracle import ORACLE_SQL as ORACLE
from tarmac.checks.registry import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    columns, rows = compare.spark_rows(df)
    oracle_columns, oracle_rows = compare.oracle_rows(con, ORACLE[name])
    assert columns == oracle_columns
    assert compare.kinds(df) == compare.oracle_kinds(con, ORACLE[name])
    assert len(rows) == len(oracle_rows)
    assert rows == oracle_rows


def test_entry_runs(spark):
    assert entry(spark).limit(1).count() == 1
