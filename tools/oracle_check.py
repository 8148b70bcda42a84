"""Run queries in Spark and their oracle SQL in DuckDB; compare results.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from shoppulse.plans.catalog import load_all  # noqa: E402
from shoppulse.plans.fixtures import TABLES  # noqa: E402
from shoppulse.session import get_session  # noqa: E402


STRICT = os.environ.get("STRICT") == "1"  # compare floats bit for bit


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    reg = load_all()
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, (fn, sql) in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sp = fn(spark, sf_dir)
            spd = sp.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if sql is None:
            print(f"rows-only {name}: {len(spd)} rows {dt:.1f}s")
            continue
        try:
            dd = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {str(e)[:400]}")
            bad += 1
            continue
        c1, r1 = rows(spd)
        c2, r2 = rows(dd)
        if c1 != c2:
            print(f"MISMATCH-COLS {name}: {c1} vs {c2}")
            bad += 1
        elif len(r1) != len(r2):
            print(f"MISMATCH-ROWS {name}: spark {len(r1)} duck {len(r2)}")
            bad += 1
        elif r1 != r2:
            diff = [(a, b) for a, b in zip(r1, r2) if a != b]
            print(f"MISMATCH-VALUES {name}: {len(diff)} rows differ, e.g. {str(diff[:2])[:600]}")
            bad += 1
        else:
            print(f"ok {name}: {len(r1)} rows {dt:.1f}s")
    print(f"bad={bad}")
    spark.stop()


if __name__ == "__main__":
    main()
