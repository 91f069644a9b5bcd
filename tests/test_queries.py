"""Every registered query of the library against its SQL twin, or for its rows."""

import os

import pytest

import foldspark.queries  # noqa: F401
from foldspark import registry

from .oracle import difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert not difference(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["chain_id", "k", "q"]
