"""Every registered query of the library against its SQL."""

import pytest

from lorekeep.plans import agents, functions, history, insight, queues, registry, retrieval, rollups, rows, seams, search, stores, surfaces  # noqa: F401
from tests.conftest import SMALL
from tests.oracle import assert_same, connect

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SMALL)
    if name in registry.oracle_sql():
        assert_same(df, con, registry.oracle_sql()[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
