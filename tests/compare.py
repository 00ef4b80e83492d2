"""Run registered queries against DuckDB. Usage: python tests/compare.py [name-prefix ...]"""

from __future__ import annotations

import glob
import os
import signal
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_" or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, float):
            return repr(float(v)) if not float(v).is_integer() else str(int(v))
        return str(v)

    cols = sorted(pdf.columns)
    return sorted(tuple(cell(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def check(spark, con, name, fn, sql, sf_dir) -> str | None:
    print(f"... {name} spark", end="", flush=True)
    got = fn(spark, sf_dir).toPandas()
    print(" done, sql ", end="", flush=True)
    if sql is None:
        return None if len(got) else "no rows"
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        sa, sb = set(a), set(b)
        return (f"{len(a)} rows vs {len(b)}; cols {sorted(got.columns)}\n  spark only: {sorted(sa - sb)[:3]}"
                f"\n  duckdb only: {sorted(sb - sa)[:3]}")
    kinds = [c for c in got.columns if (got[c].dtype.kind in "fc") != (want[c].dtype.kind in "fc")
             and got[c].dtype.kind in "iuf" and want[c].dtype.kind in "iuf"]
    return f"(types differ: {kinds})" if kinds and len(a) else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from leafmill.session import get_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "12g", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    wanted = [n for n in qs if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    def late(*_):
        raise TimeoutError("over the time limit")

    signal.signal(signal.SIGALRM, late)
    bad = 0
    for n in wanted:
        t = time.time()
        signal.alarm(int(os.environ.get("LIMIT", "60")))
        try:
            problem = check(spark, con, n, qs[n], sqls.get(n), sf)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        signal.alarm(0)
        took = time.time() - t
        if problem:
            bad += 1
        print(f"{'BAD ' if problem else 'ok  '} {n} {took:.1f}s {'' if n in sqls else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} ok")
