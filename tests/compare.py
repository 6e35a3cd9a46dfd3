"""Run a query on Spark and its check SQL on DuckDB over the same tables and compare all rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def row_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, sql: str, con):
    rel = con.sql(sql)
    d_cols, d_rows = row_set(rel.columns, rel.fetchall())
    s_cols, s_rows = row_set(df.columns, [tuple(r) for r in df.collect()])
    return s_cols, s_rows, d_cols, d_rows


def report(name, fn, sql, spark, sf_dir, con) -> bool:
    t0 = time.time()
    if sql is None:
        n = len(fn(spark, sf_dir).collect())
        print(f"{name:34s} rows-only {n} {time.time() - t0:.1f}s", flush=True)
        return n > 0
    rel = con.sql(sql)
    d_cols, d_rows = row_set(rel.columns, rel.fetchall())
    t1 = time.time()
    df = fn(spark, sf_dir)
    s_cols, s_rows = row_set(df.columns, [tuple(r) for r in df.collect()])
    t2 = time.time()
    ok = s_cols == d_cols and s_rows == d_rows and len(s_rows) > 0
    print(f"{name:34s} {'ok  ' if ok else 'FAIL'} spark={len(s_rows)} duck={len(d_rows)} {t2 - t1:.1f}s duck {t1 - t0:.1f}s", flush=True)
    if not ok:
        print("   cols", s_cols, d_cols)
        a, b = set(s_rows), set(d_rows)
        for label, rows in (("spark only", a - b), ("duck only", b - a)):
            for r in sorted(rows, key=repr)[:4]:
                print("   ", label, len(rows), str(r)[:600])
    return ok


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from riskloom.session import build_session

    sf = "/root/testdata/sf" + sys.argv[1]
    names = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "riskloom.input.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    qs, oracles, con = entry.queries(), entry.oracle_sql(), duck(sf)
    bad = []
    for name in qs:
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            if not report(name, qs[name], oracles.get(name), spark, sf, con):
                bad.append(name)
        except Exception as err:
            bad.append(name)
            print(f"{name:34s} ERROR {type(err).__name__} {str(err)[:1500]}", flush=True)
    print("bad:", bad)
