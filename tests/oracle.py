"""Runs queries beside their SQL and compares rows."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return int(x) if x == int(x) else float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, datetime.datetime) and x.time() == datetime.time():
        return x.date()
    return x


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    frame = query(spark, sf_dir)
    got = frame.collect()
    t1 = time.time()
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    t2 = time.time()
    order = sorted(names)
    if sorted(frame.columns) != order:
        return f"{name}: columns {sorted(frame.columns)} and {order}"
    a = sorted([tuple(plain(r[c]) for c in order) for r in got], key=str)
    b = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in want], key=str)
    if a != b:
        odd = [x for x in zip(a, b) if x[0] != x[1]][:2]
        return f"{name}: {len(a)} and {len(b)} rows, e.g. {odd}"
    return f"ok {name} {len(a)} rows, {t1 - t0:.1f} s, SQL {t2 - t1:.1f} s"
