"""Rows of a query and of its SQL in DuckDB, made comparable."""

import os
from collections import Counter

import duckdb


def database(folder):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return db


def _plain(row):
    return repr(tuple(round(x, 9) if isinstance(x, float) else x for x in row))


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(_plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def sql_rows(db, sql):
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(_plain(tuple(r[i] for i in order)) for r in cursor.fetchall())
