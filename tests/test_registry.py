"""Every registered query against its DuckDB oracle (sf0.001 by default)."""

import pytest

from conftest import SF_CHECK
from pairlab.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def con():
    from pairlab.plans.check import duck
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    from pairlab.plans.check import compare
    r = compare(spark, con, name, SF_CHECK)
    assert r["status"] in ("match", "rows-only"), r


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
