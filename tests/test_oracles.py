"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        compare(con, df, registry.ORACLES[name])
    else:
        assert df.count() > 0
