"""Every registered query of the mesh engine against its independent SQL; the others must give rows."""

import pytest

from meshloom import plans
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, sf, name):
    assert_same(spark, sf, plans.QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_gives_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 31
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
