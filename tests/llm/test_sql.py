import pytest

from textloom.llm import queries

from ..oracle import DATA, needs_data, same

SQL = queries.oracle_sql()


@needs_data
@pytest.mark.parametrize("name", list(queries.queries()))
def test_against_sql(spark, name):
    query = queries.queries()[name]
    if name in SQL:
        same(spark, query, SQL[name])
    else:
        assert query(spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
