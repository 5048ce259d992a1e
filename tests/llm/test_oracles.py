"""Registered queries against their SQL."""

import oracle
import pytest

from jobreview.llm import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, sf_dir, con, name):
    assert oracle.difference(spark, registry.QUERIES[name], SQL[name], sf_dir, con) is None


def test_each_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14))
