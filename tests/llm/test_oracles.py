"""The corpus queries that SQL can express, against it; and the registry."""

import pytest

import __spark_entry__ as entry
from tessera.llm import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.001")


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
