"""Every training-data query against its SQL; those without SQL run and are compared with brute force in the other modules."""

import pytest
from conftest import SF, rows_of, sql_rows

from cuelattice.llm import registry


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names, want = sql_rows(duck, registry.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_all_registered():
    import __spark_entry__ as e

    have = set(e.queries())
    assert set(registry.queries()) | {"pipeline"} <= have
    assert [sum(n.startswith(f"op{k}_") for n in have) for k in range(1, 11)] == [1] * 10
