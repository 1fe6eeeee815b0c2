"""Every query with an oracle returns what SQL returns over the whole tables."""

import pytest

from corpusflow.plans.catalogue import ORACLES, QUERIES
from tests.oracle import compare, oracle_connection


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, connection, name):
    assert compare(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
