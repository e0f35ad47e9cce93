"""Every registered query against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__
from verification import check
from verification.oracle import ORACLE_SQL
from verification.queries import QUERIES

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check.connect(SMALLEST)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert check.difference(spark, connection, SMALLEST, name) == ""


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert QUERIES.items() <= __spark_entry__.queries().items()
    assert ORACLE_SQL.items() <= __spark_entry__.oracle_sql().items()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
