"""Every query against DuckDB on the smallest tables, as the driver does it."""

import duckdb
import pytest

from mnemospark.plans import catalog, catalog_life, catalog_more, catalog_streams  # noqa: F401
from mnemospark.plans.views import TABLES

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.SQL:
        assert got and df.columns
        return
    rel = duck.sql(catalog.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    names = sorted(df.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    key = lambda r: repr(tuple(plain(r[c]) for c in names))
    assert sorted(map(key, got)) == sorted(map(key, want))
