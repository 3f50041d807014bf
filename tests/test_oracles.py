"""Every registered query against its SQL on the smallest tables."""

import pytest

from tessera.plans import registry
from tests.oracle import compare

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    query = registry.queries()[name]
    if name in ORACLES:
        compare(spark, query, ORACLES[name], "/root/testdata/sf0.001")
    else:
        assert query(spark, "/root/testdata/sf0.001").limit(5).collect()
