"""Every query of the engine against its SQL."""

import pytest

from tests import oracle
from tests.conftest import SF
from textloom.plans import registry

SLOW = {"chunked_hybrid_search", "answers"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL)))
def test_matches_sql(spark, con, name):
    oracle.check(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns
    assert df.count() >= 0


def test_entry_is_importable():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
