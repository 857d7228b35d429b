"""Run registered queries in Spark and their SQL in DuckDB and compare the results
the way the correctness gate does: columns by name, rows as an unordered multiset.

    python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v, digits=9):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        return norm(v.asDict(), digits)
    if isinstance(v, dict):
        return tuple((k, norm(x, digits)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist(), digits)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits)
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir, digits=9):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    t2 = time.time()
    msg = []
    if sorted(s_cols) != sorted(d_cols):
        msg.append(f"columns differ: spark={s_cols} duck={d_cols}")
        return False, "; ".join(msg), (t1 - t0, t2 - t1)
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    dorder = [d_cols.index(s_cols[i]) for i in order]
    a = sorted((tuple(norm(r[i], digits) for i in order) for r in s_rows), key=repr)
    b = sorted((tuple(norm(r[i], digits) for i in dorder) for r in d_rows), key=repr)
    if len(a) != len(b):
        msg.append(f"rows differ: spark={len(a)} duck={len(b)}")
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        only_a = [x for x in a if repr(x) not in sb][:2]
        only_b = [x for x in b if repr(x) not in sa][:2]
        msg.append(f"values differ; spark-only={str(only_a)[:600]} duck-only={str(only_b)[:600]}")
    return not msg, "; ".join(msg) or f"{len(a)} rows", (t1 - t0, t2 - t1)


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    from lexiforge.session import local_session
    import __spark_entry__ as E

    spark = local_session(8)
    con = duck(sf_dir)
    qs, oracles = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if args and not any(a in name for a in args):
            continue
        if name not in oracles:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"ROWS  {name}: {n} rows ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            ok, info, (ts, td) = compare(spark, con, name, qs[name], oracles[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, info, ts, td = False, f"ERROR {type(e).__name__}: {str(e)[:800]}", 0, 0
        bad += not ok
        print(f"{'OK   ' if ok else 'FAIL '}{name}: {info} (spark {ts:.1f}s, duck {td:.1f}s)", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
