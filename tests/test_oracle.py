"""Every query with an SQL oracle agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from conftest import SF_SMALL
from shoppulse.plans.catalog import load_all
from shoppulse.plans.fixtures import TABLES

REG = load_all()
WITH_SQL = sorted(n for n, (_, sql) in REG.items() if sql)


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, str):
        return _norm(v.item())
    return v


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_duckdb(spark, con, name):
    fn, sql = REG[name]
    got = fn(spark, SF_SMALL).toPandas()
    want = con.execute(sql).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["word", "tf_idf"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
