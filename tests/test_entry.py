"""The driver's contract, with or without the optional subpackage."""

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 137
