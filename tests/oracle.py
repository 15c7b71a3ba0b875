"""Run a registered query and its oracle SQL and compare them: ``python -m tests.oracle NAME... [--sf 0.01]``."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}" if v != 0 else "0"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, name, query, sql, sf_dir):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"{name}: columns {got_cols} and {want_cols}"
    if got != want:
        only = [r for r in got if r not in set(want)][:3]
        miss = [r for r in want if r not in set(got)][:3]
        return f"{name}: {len(got)} and {len(want)} rows; only in Spark {only}; only in SQL {miss}"
    return None


def main(args):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    import __spark_entry__ as e
    from harborlight.session import local_session

    spark, qs, sqls = local_session(), e.queries(), e.oracle_sql()
    sf_dir = f"/root/testdata/sf{sf}"
    bad = 0
    for name in args or list(qs):
        t = time.time()
        try:
            if name in sqls:
                why = compare(spark, name, qs[name], sqls[name], sf_dir)
            else:
                n = len(qs[name](spark, sf_dir).collect())
                why = None if n else "no rows"
                print(f"{name}: {n} rows, no SQL", flush=True)
        except Exception as x:  # noqa: BLE001 - report and go on with the next query
            why = f"{name}: {type(x).__name__} {str(x)[:1500]}"
        bad += bool(why)
        print(("BAD " + why) if why else f"ok  {name}", f"{time.time() - t:.1f}s", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
