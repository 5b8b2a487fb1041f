import pytest
from compare import connection, rows

from helixsieve.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    assert rows(queries()[name](spark, SF).toPandas()) == rows(connection(SF).execute(oracle_sql()[name]).df())
