"""Every registered query against its oracle, and row checks for those that SQL cannot express."""

from __future__ import annotations

import pytest
from compare import assert_same

from lamina.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), sf_dir, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
