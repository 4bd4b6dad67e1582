"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import check, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert check(spark, con, name, queries()[name], oracle_sql()[name], SF) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_names():
    assert set(oracle_sql()) <= set(queries())
