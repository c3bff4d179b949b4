import pytest

from loopsight import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_what_sql_gives(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
