"""Holds a query's rows against its SQL in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb
import pyarrow.parquet as pq


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    if v.__class__.__name__ == "Decimal":
        return int(v) if v == int(v) else float(v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def by_sql(sf, sql):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.register(f.stem, pq.read_table(f))
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), ordered(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def by_spark(df):
    names = sorted(df.columns)
    return names, ordered(tuple(plain(r[n]) for n in names) for r in df.collect())
