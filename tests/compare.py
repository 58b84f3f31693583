"""Spark vs DuckDB comparison, as the driver does it (rows, columns, values)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, qfn, sql, sf_dir):
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    s_sorted, s_cols = rows_of(sdf.columns, srows)
    d_sorted, d_cols = rows_of(dcols, drows)
    ok = s_cols == d_cols and s_sorted == d_sorted
    detail = ""
    if not ok:
        if s_cols != d_cols:
            detail = f"cols spark={s_cols} duck={d_cols}"
        else:
            ss, ds = set(s_sorted), set(d_sorted)
            detail = (f"rows spark={len(s_sorted)} duck={len(d_sorted)} "
                      f"only_spark={sorted(ss - ds)[:3]} only_duck={sorted(ds - ss)[:3]}")
    return ok, len(srows), t1 - t0, detail


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from courtline.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    from courtline import registry
    qs, sqls = registry.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            n = fn(spark, sf_dir).count()
            print(f"{name:28s} NO-ORACLE rows={n}")
            continue
        ok, n, dt, detail = compare(spark, con, name, fn, sqls[name], sf_dir)
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} rows={n:<7d} {dt:6.2f}s {detail}")
    print("mismatches:", bad)


if __name__ == "__main__":
    main(sys.argv)
