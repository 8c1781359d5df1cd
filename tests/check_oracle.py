"""Compare registered queries with their SQL: ``python tests/check_oracle.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import math
import pathlib
import sys
import time
import traceback

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def difference(df, con, sql: str) -> str | None:
    """None when schema, row count and values agree."""
    cols = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in order) for r in rows]
    have = [tuple(norm(v) for v in r) for r in got]
    if len(have) != len(want):
        return f"rows {len(have)} vs {len(want)}"
    key = lambda row: tuple((v is not None, str(type(v)), str(v)) for v in row)
    have.sort(key=key)
    want.sort(key=key)
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(have)} rows differ, cols {cols}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    if not have:
        return "EMPTY"
    kinds = {c: {type(r[i]).__name__ for r in have if r[i] is not None} for i, c in enumerate(cols)}
    sqlk = {c: {type(r[i]).__name__ for r in want if r[i] is not None} for i, c in enumerate(cols)}
    return None if kinds == sqlk else f"types {kinds} vs {sqlk}"


def main() -> int:
    from fluxprint import session
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session.build("local[8]", "check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = oracle_sql().get(name)
            if sql is None:
                n = df.count()
                result = None if n else "EMPTY (no oracle)"
                note = f"rows {n}, no oracle"
            else:
                result = difference(df, con, sql)
                note = ""
        except Exception as e:  # report and go on
            text = str(e)
            result, note = f"{type(e).__name__}: {text[:1500]}", ""
            if not isinstance(e, duckdb.Error):
                traceback.print_exc(limit=3)
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - began:.1f}s {note}{result or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
