"""Every registered graph query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from claimweave import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, (bool, int, str)):
        return str(v)
    return f"{float(v):.6g}" if hasattr(v, "as_integer_ratio") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got, "a query without rows compares nothing"
    if name not in catalog.oracle_sql():
        return
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall())

