"""Order-insensitive comparison of a query with its oracle."""

from __future__ import annotations

import math

import duckdb

from clickweave.sources.fixtures import TABLES


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def type_differences(df, con, sql):
    cur = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in cur.description}
    ours = {n: KINDS.get(t, t) for n, t in df.dtypes}
    return {n: (ours.get(n), theirs.get(n)) for n in ours.keys() | theirs.keys() if ours.get(n) != theirs.get(n)}
