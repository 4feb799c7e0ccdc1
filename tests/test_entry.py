"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_flagship_and_keys(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
