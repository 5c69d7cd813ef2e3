"""Comparison of a query with its SQL on the same tables."""

import glob
import math
import os

import duckdb


def plain(v):
    if v is None:
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)[:19] if hasattr(v, "isoformat") else v


def both(spark, folder, query, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = query(spark, folder)
    names = sorted(df.columns)
    rel = con.sql(sql)
    assert names == sorted(rel.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    left = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=key)
    right = sorted((tuple(map(plain, r)) for r in rel.select(", ".join(f'"{n}"' for n in names)).fetchall()), key=key)
    return left, right
