"""Every catalog query against DuckDB on the driver tables."""

import os

import pytest

from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from duck import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, connection):
    assert differences(QUERIES[name](spark, SF_DIR), connection, ORACLE[name]) == []


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "rule_name"
