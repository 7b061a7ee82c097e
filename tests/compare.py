"""Rows of a query and of its SQL in one comparable form."""

import os

import duckdb

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(row):
    return tuple("~" if x is None else f"{x + 0.0:.9g}" if isinstance(x, float) else str(x) for x in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(plain(r) for r in df.select(*cols).collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    types = {d[0]: str(d[1]) for d in cur.description}
    return sorted(names), sorted(plain([r[k] for k in order]) for r in cur.fetchall()), types


def assert_same(df, con, sql):
    cols, mine = spark_rows(df)
    names, theirs, types = duck_rows(con, sql)
    assert cols == names
    assert {c: TYPES.get(t) for c, t in df.dtypes} == types
    assert mine == theirs
