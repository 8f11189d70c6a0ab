"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import rows

LLM = {"p6", "p7", "p8"}
NAMES = sorted(n for n in entry.oracle_sql() if n[:2] not in LLM)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, small, name):
    got = entry.queries()[name](spark, small).toArrow()
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark, small):
    assert entry.queries()["features_wide"](spark, small).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
