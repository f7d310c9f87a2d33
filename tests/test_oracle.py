import pytest
from oracle import connect, differences

from helixspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert differences(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], con) == ""
