"""Rows of a query and of its SQL, in a form that can be compared."""

import os

import duckdb


def connect(folder):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return connection


def plain(value):
    if value is None or value != value:
        return "null"
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def duckdb_rows(connection, sql):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())
