"""Run queries on Spark and their SQL on the checking engine, and compare values and types."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from lettermark.sources.adapters import TABLES

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "FLOAT": "float"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    return "<null>" if v is None else str(v)


def compare(spark, con, folder: str, name: str):
    """Return (seconds, rows, problem or '')."""
    t0 = time.time()
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - t0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return took, len(got), ""
    res = con.execute(sql)
    desc = {d[0]: str(d[1]) for d in res.description}
    rows = res.fetchall()
    if sorted(desc) != cols:
        return took, len(got), f"columns {cols} vs {sorted(desc)}"
    types = {f: (dict(df.dtypes)[f], TYPES.get(desc[f], desc[f])) for f in cols}
    bad = {f: t for f, t in types.items() if t[0] != t[1]}
    if bad:
        return took, len(got), f"types {bad}"
    names = [d[0] for d in res.description]
    want = [tuple(_norm(r[names.index(c)]) for c in cols) for r in rows]
    if sorted(got) != sorted(want):
        a, b = set(got) - set(want), set(want) - set(got)
        return took, len(got), f"rows {len(got)} vs {len(want)}; cols {cols}; spark only {sorted(a)[:3]} ({len(a)}); sql only {sorted(b)[:3]} ({len(b)})"
    return took, len(got), ""


if __name__ == "__main__":
    from lettermark.session import local_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in entry.queries():
        if only and not any(o in name for o in only):
            continue
        try:
            took, n, problem = compare(spark, con, folder, name)
        except Exception as e:  # report and go on
            took, n, problem = 0, 0, f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(problem)
        mark = "" if name in entry.oracle_sql() else "(no sql)"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {n:8d} rows {took:6.2f}s {mark} {problem}", flush=True)
    print("failures:", bad)
