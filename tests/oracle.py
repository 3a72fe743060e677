"""Side-by-side check of a registered query against its DuckDB SQL (the driver's correctness
gate, reproduced locally): same column names, same row count, same values (order-insensitive,
doubles compared after rounding)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

import os

STRICT = os.environ.get("ORACLE_STRICT") == "1"  # compare doubles bit for bit, as a value hash would
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def frame_rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> tuple[bool, str]:
    con = con or duck(sf_dir)
    t0 = time.time()
    s = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    d = con.sql(sql).df()
    t2 = time.time()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: spark={sorted(s.columns)} duck={sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"row count spark={len(s)} duck={len(d)}"
    rs, rd = frame_rows(s), frame_rows(d)
    bad = [(a, b) for a, b in zip(rs, rd) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, first: spark={bad[0][0]!r:.300} duck={bad[0][1]!r:.300}"
    return True, f"ok rows={len(s)} spark={t1 - t0:.2f}s duck={t2 - t1:.2f}s"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from textprep.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = build_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    n_ok = 0
    for name, fn in qs.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        if name not in sqls:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"ROWS  {name}: {n} rows {time.time() - t0:.2f}s", flush=True)
            continue
        try:
            ok, msg = compare(spark, name, fn, sqls[name], sf_dir, con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:500]}"
        n_ok += ok
        print(f"{'PASS' if ok else 'FAIL'}  {name}: {msg}", flush=True)
    print(f"{n_ok} passed")
