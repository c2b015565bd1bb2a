"""Rows of a DataFrame and of DuckDB SQL in a comparable form."""

import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return c


def _plain(v):
    if v is None or v != v:
        return None
    if type(v).__name__ == "Decimal":
        return float(v)
    return round(v, 7) if isinstance(v, float) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(_plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
