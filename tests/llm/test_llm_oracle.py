import pytest
from oracle import connect, differences

from helixspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], con) == ""
