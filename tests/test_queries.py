"""Every core query runs, and equals its SQL where it has one."""

import pytest
from oracle import database, spark_rows, sql_rows

import __spark_entry__
from folioweave.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, name):
    assert spark_rows(QUERIES[name](spark, small)) == sql_rows(database(small), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
