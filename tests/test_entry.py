"""The driver's contract."""

import __spark_entry__ as entry
from sparkloom import catalog


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 60


def test_entry(spark):
    assert entry.entry(spark).columns == ["issue", "n"] and entry.entry(spark).count() > 0
