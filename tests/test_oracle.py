"""Every registered query against its oracle, all rows, exactly."""

import pytest

from checks.compare import compare, connect
from checks.oracle_queries import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, sf, duck, name):
    assert compare(spark, duck, name, sf) == ""
