"""Every registered query with an SQL twin gives the same rows as DuckDB."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    frame = queries()[name](spark, SF_DIR).toPandas()
    assert difference(frame, duck.execute(oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
