"""Every registered query that has a SQL twin agrees with it on the smallest tables."""
import pytest
from harness import compare, duck

from barflow.catalog import all_oracles, all_queries


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_oracle(spark, con, data, name):
    ok, message, _ = compare(spark, con, data, all_queries()[name], all_oracles()[name])
    assert ok, message


def test_names_match():
    assert set(all_oracles()) <= set(all_queries())
