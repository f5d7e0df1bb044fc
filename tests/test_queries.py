"""Every query with SQL against DuckDB on the smallest tables; every other one runs and keeps its schema."""

from __future__ import annotations

import pytest
from compare import differences

from lectern import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    assert differences(catalog.queries()[name](spark, FOLDER), FOLDER, catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    assert df.columns and df.count() >= 0
