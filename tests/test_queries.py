"""Every query of the library against its SQL on DuckDB, or that it runs."""

import pytest
from tests.conftest import DATA, same_rows

from tallyloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, DATA)
    if name in SQL:
        same_rows(out, SQL[name])
    else:
        assert out.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
