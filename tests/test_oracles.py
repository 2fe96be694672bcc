"""Every registered query beside its DuckDB twin on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import connect, difference

from tallyspark import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="the given tables are not here")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    if name not in ORACLES:
        assert df.count() >= 1
        return
    said = difference(df, duck, ORACLES[name])
    assert said in (None, "no rows"), said


def test_entry_runs(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
