"""Core queries against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from plumbline.catalog import core_queries, core_sql

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not SF.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v.item() if hasattr(v, "item") else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(norm(v) for v in r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core_sql()))
def test_query(spark, con, name):
    assert rows(core_queries()[name](spark, str(SF)).toPandas()) == rows(con.execute(core_sql()[name]).df())


def test_every_query_has_stable_columns(spark):
    assert set(core_sql()) <= set(core_queries())
