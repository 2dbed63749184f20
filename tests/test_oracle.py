"""Every query with SQL against DuckDB, and the others for rows and a schema.

At sf0.01, where the machine has it: a condition that cuts rows may cut none at a smaller size.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, same
from vecloom.plans import catalog


@pytest.fixture(scope="module")
def sf_dir(sf_dir):
    larger = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")
    return larger if os.path.isdir(larger) else sf_dir


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, con, name):
    same(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
