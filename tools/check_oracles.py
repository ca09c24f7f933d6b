"""Run catalogue queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tools/check_oracles.py [sf_dir] [name ...]
Prints one line per query: OK / MISMATCH / ERROR with row counts and timing.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ledgerlens.plans import load_all  # noqa: E402
from ledgerlens.session import get_spark  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    queries, oracles = load_all()
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = sorted(df.columns)
            srows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"ERROR spark {name}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = oracles.get(name)
        if sql is None:
            print(f"NOSQL {name}: spark rows={len(srows)} {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            rel = con.sql(sql)
            ocols = rel.columns
            data = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR sql {name}: {str(e)[:400]}")
            bad += 1
            continue
        to = time.time() - t1
        if sorted(ocols) != cols:
            print(f"MISMATCH {name}: columns spark={cols} sql={sorted(ocols)}")
            bad += 1
            continue
        idx = [ocols.index(c) for c in cols]
        orows = [tuple(norm(r[i]) for i in idx) for r in data]
        srows.sort(key=key)
        orows.sort(key=key)
        if srows == orows:
            print(f"OK {name}: rows={len(srows)} spark={ts:.1f}s sql={to:.1f}s")
        else:
            bad += 1
            diff = [(a, b) for a, b in zip(srows, orows) if a != b][:3]
            print(f"MISMATCH {name}: rows spark={len(srows)} sql={len(orows)} first diffs={diff}")
    print(f"done, {bad} bad")


if __name__ == "__main__":
    main()
