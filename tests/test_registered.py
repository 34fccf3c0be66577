"""Every registered query of the engine against its SQL, run by another engine."""

from pathlib import Path

import duckdb
import pytest

from axonspark.plans import registered

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_same_rows(spark, other, name):
    df = registered.QUERIES[name](spark, str(DATA))
    want = other.sql(registered.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert got == sorted(repr([r[want.columns.index(c)] for c in order]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
