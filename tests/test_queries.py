"""Every registered query against its DuckDB text on the smallest tables."""

import functools

import pytest

from countwatch.plans import live_queries
from countwatch.plans.registry import ORACLES, QUERIES
from oracle import connect, difference


@pytest.fixture(scope="module")
def con(sf_small):
    return connect(sf_small)


@pytest.fixture(scope="module", autouse=True)
def one_live_run():
    """The live queries read one store; build it once for the module."""
    original = live_queries.live_edge
    live_queries.live_edge = functools.lru_cache(original)
    yield
    live_queries.live_edge = original


#: Their optimum is found by steps: tests/test_refined_fit.py compares them with finer searches.
NO_TEXT = {"ets_refined"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) - NO_TEXT == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, sf_small, name):
    assert difference(QUERIES[name](spark, sf_small), con, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6 * 79
    assert set(QUERIES) - NO_TEXT <= set(entry.oracle_sql()) <= set(entry.queries())
