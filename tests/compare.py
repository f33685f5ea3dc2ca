"""Holds a query's rows against its SQL in DuckDB, as sets of values by column name."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connected(sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def rows_by_name(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def assert_same(con, df, sql):
    got = df.collect()
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    want = want.fetchall()
    assert len(got) == len(want)
    assert rows_by_name([tuple(r) for r in got], df.columns) == rows_by_name(want, columns)
