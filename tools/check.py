"""Run registered queries against their SQL twins in DuckDB.

usage: python tools/check.py [--sf DIR] [--only name,name | --module plans_module] [--explain]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tickloom.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(v, float) and v != v:
        return "NaN"
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def kinds(df):
    m = {"bigint": "int64", "int": "int32", "double": "double", "string": "string", "date": "date",
         "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ts"}
    return {n: m.get(t, t) for n, t in df.dtypes}


def duck_kinds(desc):
    m = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
         "BOOLEAN": "bool", "TIMESTAMP": "ts"}
    return {d[0]: m.get(str(d[1]), str(d[1])) for d in desc}


def compare(df, con, sql):
    t = time.time()
    got = df.collect()
    spark_sec = time.time() - t
    cur = con.execute(sql)
    dk = duck_kinds(cur.description)
    want = cur.fetchall()
    a_names, a = rows_of(df.columns, got)
    b_names, b = rows_of(list(dk), want)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}", len(got), spark_sec
    types = [f"{n}:{k}/{dk[n]}" for n, k in kinds(df).items() if k != dk[n]]
    msg = f"types {types}" if types else ""
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; {msg}", len(got), spark_sec
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = {n: (p, q) for n, p, q in zip(a_names, x, y) if p != q}
        return f"{len(bad)}/{len(a)} rows differ, e.g. {diff} in {dict(zip(a_names, x))}; {msg}"[:900], len(got), spark_sec
    return msg, len(got), spark_sec


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--module", default="")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args()
    if args.module:
        import importlib
        for m in args.module.split(","):
            importlib.import_module(f"tickloom.plans.{m}")
    else:
        from tickloom.plans import catalogue  # noqa: F401
    from tickloom.plans.registry import QUERIES, SQL
    names = [n for n in QUERIES if not args.only or n in args.only.split(",")]
    spark, con, failed = local_session(), connect(args.sf), []
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, args.sf)
            if args.explain:
                df.explain("formatted")
            if n in SQL:
                msg, rows, sec = compare(df, con, SQL[n])
            else:
                msg, rows, sec = "(rows only)", len(df.collect()), time.time() - t
        except Exception as e:  # report and go on
            msg, rows, sec = f"ERROR {type(e).__name__}: {str(e)[:700]}", -1, 0.0
        ok = msg in ("", "(rows only)")
        if not ok:
            failed.append(n)
        print(f"{'ok  ' if ok else 'FAIL'} {n:28s} {rows:6d} rows spark {sec:6.2f}s all {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
