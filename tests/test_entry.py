"""The driver's contract."""

from __future__ import annotations

import __spark_entry__


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.schema == __spark_entry__.entry(spark).schema
    assert df.count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(map(callable, __spark_entry__.queries().values()))
