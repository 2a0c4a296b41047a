"""Every query of the catalogue against its SQL in DuckDB."""

import datetime as dt

import duckdb
import pytest

from lodestone.plans import catalogue, families  # noqa: F401 - families registers its queries
from lodestone.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else v.isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows, cols = df.collect(), df.columns
    if name not in catalogue.ORACLE_SQL:
        assert cols and len(rows) > 0
        return
    r = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(cols) == sorted(r.columns)
    order = sorted(cols)
    got = sorted(tuple(plain(x[c]) for c in order) for x in rows)
    want = sorted(tuple(plain(x[r.columns.index(c)]) for c in order) for x in r.fetchall())
    assert got == want
