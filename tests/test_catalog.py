"""Every query against its SQL, at the smallest scale."""

import pytest
from conftest import SF, same_rows

from newsloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SF), duck, catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
