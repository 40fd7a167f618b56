import pytest
from conftest import same_as_sql

from tallyrand import plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    same_as_sql(spark, name, plans.queries()[name], SQL[name])


def test_every_sql_has_its_query():
    assert set(SQL) <= set(plans.queries())
