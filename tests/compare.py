"""Compare a registered query with its SQL as multisets of rows with columns sorted by name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def sql_rows(con, statement):
    r = con.sql(statement)
    columns = sorted(r.columns)
    at = [r.columns.index(c) for c in columns]
    return columns, sorted(repr(tuple(plain(x[k]) for k in at)) for x in r.fetchall())
