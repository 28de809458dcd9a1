"""Every query of the engine's own operators against its SQL."""

from __future__ import annotations

import pytest

from grainmill import plans
from tests.compare import same_rows, tables
from tests.conftest import SF

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    same_rows(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "version_id", "title", "snippet", "star_count", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
