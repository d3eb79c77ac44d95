"""Each query of the catalog against its DuckDB counterpart; those without one must return rows of a stable schema."""

from __future__ import annotations

import os

import pytest

from itemloom.plans import catalog
from tests.compare import duck, duck_rows, spark_rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    columns, rows = spark_rows(catalog.queries()[name](spark, FOLDER))
    want_columns, want = duck_rows(con, catalog.oracle_sql()[name])
    assert columns == want_columns
    assert len(rows) == len(want)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_without_sql(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    assert df.columns == catalog.queries()[name](spark, FOLDER).columns
    if name != "page_tables":  # pages of the synthetic data hold no table; tests/test_sources.py reads some that do
        assert df.count() > 0
