"""Corpus queries against their SQL."""

import pytest

from tests.oracle import compare, connect
from tunelens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    compare(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLES[name], sf_dir)
