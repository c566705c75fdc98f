import pytest

from textloom.plans import registry

from .oracle import DATA, needs_data, same

SQL = registry.oracle_sql()


@needs_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, name):
    query = registry.queries()[name]
    if name in SQL:
        same(spark, query, SQL[name])
    else:
        assert query(spark, DATA).count() > 0
