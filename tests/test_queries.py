"""Every audit query equals its SQL."""

import pytest
from oracle import compare

import __spark_entry__ as entry
from sitequarry.plans import audit


@pytest.mark.parametrize("name", sorted(audit.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, audit.QUERIES[name], audit.ORACLES[name])


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
