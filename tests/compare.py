"""Runs a registered query and its oracle and compares names, types of values and values."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v, digits=None):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return f"{f:.{digits}g}" if digits else repr(f)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x, digits)) for k, x in v.items()))
    return str(v)


def oracle_rows(sql: str, sf_dir: str, digits=None):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(tuple(plain(r[k], digits) for k in order) for r in got.fetchall())


def spark_rows(df, digits=None):
    order = sorted(range(len(df.columns)), key=lambda k: df.columns[k])
    return sorted(df.columns), Counter(tuple(plain(r[k], digits) for k in order) for r in df.collect())
