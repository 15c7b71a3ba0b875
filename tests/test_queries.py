"""Every registered query of the library against its oracle SQL."""

import pytest

from harborlight import catalog
from tests.oracle import compare

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, data, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], data) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_without_oracle_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
