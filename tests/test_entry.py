"""The driver contract: every query runs on the smallest tables and its SQL names a query."""

import __spark_entry__ as E


def test_entry_and_names(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
