"""Compares a query with its SQL run by DuckDB over the same tables; run as a script for named queries or all."""
from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd


def tables(con, folder: str) -> None:
    for p in sorted(Path(folder).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create or replace view {p.stem} as select * from read_parquet('{src}')")


def _canon(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return None
        if hasattr(v, "tolist") and not isinstance(v, str):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(one(x) for x in v)
        if isinstance(v, pd.Timestamp):
            return v.date().isoformat() if v == v.normalize() else v.isoformat()
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)) or hasattr(v, "__float__"):
            return round(float(v), 6) + 0.0
        return v

    cols = sorted(df.columns)
    return sorted((tuple(one(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


def differ(spark, folder: str, query, sql: str) -> str:
    """Empty if equal, else what differs."""
    got = query(spark, folder).toPandas()
    with duckdb.connect() as con:
        tables(con, folder)
        want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = _canon(got), _canon(want)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    near = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)))
    bad = [(x, y) for x, y in bad if not all(near(p, q) for p, q in zip(x, y))]
    return f"{len(bad)} of {len(a)} rows: {bad[:2]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as E
    from plumbline.session import local_session

    folder = sys.argv[1]
    spark, Q, O = local_session(8, "8g"), E.queries(), E.oracle_sql()
    for name in sys.argv[2:] or Q:
        t = time.time()
        try:
            if name in O:
                d = differ(spark, folder, Q[name], O[name])
                print(name, "DIFFERS " + d if d else "equal", round(time.time() - t, 1), flush=True)
            else:
                print(name, "rows", Q[name](spark, folder).count(), round(time.time() - t, 1), flush=True)
        except Exception as e:
            print(name, "ERROR", str(e)[:600], flush=True)
