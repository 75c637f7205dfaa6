"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF_DIR
from same import assert_same

from corpusloom import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert_same(catalog.queries()[name](spark, SF_DIR), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF_DIR).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    one, two = entry.entry(spark), entry.entry(spark)
    assert one.schema == two.schema and one.count() == two.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
