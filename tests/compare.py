"""Run queries next to their DuckDB oracles and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from axiomloom.plans import catalog
from axiomloom.plans.views import BASE_TABLES


def connect(folder: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: ("nan" if isinstance(v, float) and math.isnan(v) else repr(v))
    return sorted(tuple(fix(r[i]) for i in order) for r in rows)


def check(spark, con, name: str, folder: str):
    """(problem or '', rows, seconds)."""
    began = time.perf_counter()
    df = catalog.QUERIES[name](spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    took = time.perf_counter() - began
    if name not in catalog.ORACLES:
        return "", len(got_rows), took
    cur = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}", len(got_rows), took
    got, want = canonical(df.columns, got_rows), canonical(columns, want_rows)
    if got != want:
        gs, ws = set(got), set(want)
        only_got, only_want = sorted(gs - ws)[:2], sorted(ws - gs)[:2]
        return f"rows {len(got)} vs {len(want)}; diff {len(gs - ws)}/{len(ws - gs)}; spark {only_got} duckdb {only_want}", len(got), took
    return "", len(got), took


if __name__ == "__main__":
    from axiomloom import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in catalog.QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, n, took = check(spark, con, name, folder)
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, n, took = f"{type(exc).__name__}: {str(exc)[:1500]}", 0, 0.0
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:40s} rows={n:<8d} {took:6.2f}s {problem[:1800]}", flush=True)
    print("failures:", bad)
