"""The driver's contract."""

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["iter"] for r in rows] == list(range(10)) and all(r["norm"] > 0 for r in rows)
