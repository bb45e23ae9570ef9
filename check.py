"""Runs catalogue queries on Spark and their oracle on DuckDB and compares the results.

usage: check.py [--sf DIR] [name or name-prefix* ...]
"""

from __future__ import annotations

import math
import sys
import time


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main() -> int:
    import duckdb

    from tidelens.plans.catalog import catalogue
    from tidelens.session import local_session

    args = sys.argv[1:]
    root = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        root, args = args[1], args[2:]
    cat = catalogue()
    names = [n for n in cat if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    bad = 0
    for n in names:
        q = cat[n]
        t0 = time.time()
        try:
            df = q.run(spark, root)
            cols = sorted(df.columns)
            got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
            t1 = time.time()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {n}: spark: {type(e).__name__} {str(e)[:1500]}", flush=True)
            continue
        if q.oracle is None:
            print(f"rows  {n}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            res = con.execute(q.oracle)
            names_sql = [d[0] for d in res.description]
            types_sql = dict(zip(names_sql, [str(d[1]) for d in res.description]))
            raw = res.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {n}: oracle: {str(e)[:600]}", flush=True)
            continue
        t2 = time.time()
        if sorted(names_sql) != cols:
            bad += 1
            print(f"FAIL  {n}: columns spark={cols} sql={sorted(names_sql)}", flush=True)
            continue
        ix = [names_sql.index(c) for c in cols]
        want = [tuple(norm(r[i]) for i in ix) for r in raw]
        key = lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r)
        g, w = sorted(got, key=key), sorted(want, key=key)
        gs, ws = [tuple(map(str, r)) for r in g], [tuple(map(str, r)) for r in w]
        if gs == ws:
            print(f"ok    {n}: {len(g)} rows spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s", flush=True)
            continue
        bad += 1
        dg, dw = set(gs) - set(ws), set(ws) - set(gs)
        print(f"DIFF  {n}: spark {len(g)} rows, sql {len(w)} rows, {len(dg)} / {len(dw)} differ", flush=True)
        print("   ", cols, [df.schema[c].dataType.simpleString() for c in cols], [types_sql[c] for c in cols])
        for r in sorted(dg)[:3]:
            print("    spark", r)
        for r in sorted(dw)[:3]:
            print("    sql  ", r)
    print(f"{len(names)} queries, {bad} not ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
