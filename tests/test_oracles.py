"""Every query against SQL, on the sample tables."""

import re

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = connect(SAMPLE)
    yield connection
    connection.close()


# Tokenizers, seeded hashes, fitted models: held against brute force in tests of their own.
NO_SQL = re.compile(r"op(1|3|4|8|10)_|pipeline$")


def test_every_query_has_its_sql():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert not set(entry.oracle_sql()) - set(entry.queries())
    assert all(NO_SQL.match(name) for name in without)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, database, name):
    result = entry.queries()[name](spark, SAMPLE).toPandas()
    expected = database.sql(entry.oracle_sql()[name]).df()
    assert difference(result, expected) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5
