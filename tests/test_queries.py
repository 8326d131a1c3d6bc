"""Every query of the core that has an SQL twin gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from pathlib import Path

import pytest

from docveil.plans import registry

duckdb = pytest.importorskip("duckdb")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    if not Path(sf).exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in Path(sf).iterdir():
        c.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return c


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    want = duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = Counter(tuple(map(plain, r)) for r in got.select(*cols).collect())
    assert rows == Counter(tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in cols)).fetchall())


def test_names():
    assert set(SQL) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "rendered"] and df.count() > 0
