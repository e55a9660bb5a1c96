"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest

from lodestrata.plans import registry
from tests.oracle import same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    same(spark, registry.queries()[name], SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry_without_llm(spark, sf_dir):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
