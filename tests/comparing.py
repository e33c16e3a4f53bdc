"""Rows of a query against rows of its oracle."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v).replace("+00:00", "") if hasattr(v, "isoformat") else v


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def compare(df, connection, sql):
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr)
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(k) for k in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert ours == theirs
