"""Every registered query against its SQL."""

import oracle
import pytest

import __spark_entry__ as entry
from jobreview.plans import oracles
from jobreview.plans import queries as registered

QUERIES = registered.registry()
SQL = oracles.registry()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, sf_dir, con, name):
    assert oracle.difference(spark, QUERIES[name], SQL[name], sf_dir, con) is None


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 18
    assert df.count() > 0
