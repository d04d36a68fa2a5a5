"""A query's rows against those of its SQL in DuckDB, order apart."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return 0.0 if isinstance(v, float) and v == 0 else v


def rows(columns, found):
    return sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found), key=str)


def assert_same(df, con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())
