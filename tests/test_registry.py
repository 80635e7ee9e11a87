"""Every registered query with SQL against DuckDB."""

import pytest

from chromaweft.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, con, name):
    oracle.same(registry.QUERIES[name](spark, SF), con, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
