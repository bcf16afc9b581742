import pytest
from conftest import same

from gridstride import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    same(registry.queries()[name](spark, sf_dir).toPandas(), duck.sql(registry.oracle_sql()[name]).df())


def test_sql_names_are_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
