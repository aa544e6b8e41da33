"""Runs a registered query on Spark and its oracle on DuckDB and compares rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from diffloom.plans.registry import TABLES  # noqa: E402

DATA = "/root/testdata"


def duck(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() else round(v, 9))
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, name, sf="0.01", show=3, queries=None, oracles=None):
    import __spark_entry__ as entry

    folder = f"{DATA}/sf{sf}"
    start = time.time()
    df = (queries or entry.queries())[name](spark, folder)
    got_cols, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    sql = (oracles or entry.oracle_sql()).get(name)
    if sql is None:
        return f"ROWS  {name}: {sum(got.values())} rows, {took:.1f}s"
    con = duck(folder)
    start = time.time()
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want_cols, want = rows_of(cols, cur.fetchall())
    duck_took = time.time() - start
    if got_cols != want_cols:
        return f"FAIL  {name}: columns {got_cols} vs {want_cols}"
    if got != want:
        extra, lacking = got - want, want - got
        return (
            f"FAIL  {name}: {sum(got.values())} vs {sum(want.values())} rows; "
            f"only spark {list(extra.items())[:show]}; only duckdb {list(lacking.items())[:show]}"
        )
    empty = " EMPTY" if not got else ""
    return f"ok    {name}: {sum(got.values())} rows{empty}, spark {took:.1f}s, duckdb {duck_took:.1f}s"


if __name__ == "__main__":
    import re

    import __spark_entry__ as entry
    from diffloom.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if args and re.fullmatch(r"0\.\d+", args[0]):
        sf = args.pop(0)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, os_ = entry.queries(), entry.oracle_sql()
    for name in qs:
        if args and not any(re.fullmatch(a, name) for a in args):
            continue
        try:
            print(check(spark, name, sf, queries=qs, oracles=os_), flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
