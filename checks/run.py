"""Run registered queries beside their SQL and report differences.

    python -m checks.run [--sf DIR] [--only a,b] [--module q_functions]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from checks.base import ORACLES, QUERIES, TABLES, Tables
from trovekit.session import local_session


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


collect_time = 0.0


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return [names[i] for i in order], out


def compare(name, spark_df, con):
    start = time.time()
    got_names, got = rows_of(spark_df.columns, spark_df.collect())
    global collect_time
    collect_time = time.time() - start
    if name not in ORACLES:
        return len(got), "rows only" if got else "NO ROWS"
    rel = con.execute(ORACLES[name])
    want_names, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_names != want_names:
        return len(got), f"COLUMNS {got_names} != {want_names}"
    if len(got) != len(want):
        extra = list(set(got) - set(want))[:2]
        missing = list(set(want) - set(got))[:2]
        return len(got), f"ROWS {len(got)} != {len(want)} extra={str(extra)[:600]} missing={str(missing)[:600]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return len(got), f"VALUES {len(bad)} differ: {got_names} got={str(bad[0][0])[:500]} want={str(bad[0][1])[:500]}"
    return len(got), "ok"


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--module", default="")
    args = ap.parse_args()
    import checks.all_queries  # noqa: F401

    names = list(QUERIES)
    if args.module:
        names = [n for n in names if QUERIES[n].__module__ == f"checks.{args.module}"]
    if args.only:
        names = [n for n in names if n in args.only.split(",")]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = 0
    for name in names:
        start = time.time()
        try:
            n, verdict = compare(name, QUERIES[name](Tables(spark, args.sf)), con)
        except Exception as e:  # report and go on
            n, verdict = -1, f"ERROR {type(e).__name__}: {str(e)[:900]}"
        failed += verdict not in ("ok", "rows only")
        print(f"{name:28s} {n:8d} {time.time() - start:6.2f}s (collect {collect_time:6.2f}s) {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    spark.stop()
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
