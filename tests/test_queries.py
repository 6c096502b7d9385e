"""Every query of the library against its SQL on the smallest tables."""

import pytest
from compare import assert_agrees

from quillspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, sf_dir, name):
    assert_agrees(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
