"""Every query of the subpackage with SQL equals it, at the smallest scale."""

import pytest

from fitloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, duck, same_rows, name):
    same_rows(queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLES[name]))
