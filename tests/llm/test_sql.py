"""Every query of the subpackage that has SQL, against it on the smallest tables."""

import pytest
from oracle import compare, connect

from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    compare(connect(SF), QUERIES[name](spark, SF), ORACLES[name])
