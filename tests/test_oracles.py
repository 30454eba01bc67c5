"""Every query with an oracle agrees with it; the others return rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, con, sf_dir, name):
    compare(spark, con, queries()[name], oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0
