"""Every registered query against its DuckDB oracle, or at least to the end."""

import pytest

from lumenrec.plans import registry

from .conftest import SF


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
