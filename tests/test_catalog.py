"""Every query against its SQL; those without SQL run and have a stable schema."""

import pytest
from conftest import SF, rows_of, sql_rows

from cuelattice.plans import catalog


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names, want = sql_rows(duck, catalog.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
