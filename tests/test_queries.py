"""Every registered query outside the training-data subpackage, at the smallest scale, against its SQL."""

import pytest

from fitloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, same_rows, name):
    found = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        same_rows(found, duck.sql(catalog.ORACLES[name]))
    else:
        assert found.count() > 0


def test_entry_has_all_queries(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0
