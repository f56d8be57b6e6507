"""Every query with SQL returns the SQL's rows; every other one runs."""

import __spark_entry__ as entry
import pytest
from compare import compared, duck

from citeweave.plans import catalog

ORACLES = catalog.oracles()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, name):
    got = catalog.queries()[name](spark, data).toArrow()
    if name in ORACLES:
        assert compared(got, duck(data).execute(ORACLES[name]).to_arrow_table()) == ""
    else:
        assert got.num_rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_lists_all():
    assert set(ORACLES) <= set(entry.oracle_sql()) and set(catalog.queries()) <= set(entry.queries())
