"""Load fixture rows into an in-process DuckDB and compare results."""

import re

import duckdb

from quarry.plans.verify import _canon

_TYPES = {"string": "VARCHAR", "int": "INTEGER", "date": "DATE", "bigint": "BIGINT"}


def _ddl(schema: str) -> str:
    cols = []
    for part in re.split(r",\s*(?![^()]*\))", schema):
        name, typ = part.strip().split(" ", 1)
        cols.append(f"{name} {_TYPES.get(typ, typ.upper())}")
    return ", ".join(cols)


def load(schemas: dict, rows: dict):
    con = duckdb.connect()
    for name, schema in schemas.items():
        con.execute(f"CREATE TABLE {name} ({_ddl(schema)})")
        if rows[name]:
            marks = ", ".join("?" for _ in rows[name][0])
            con.executemany(f"INSERT INTO {name} VALUES ({marks})", rows[name])
    return con


def same(df, con, sql: str):
    s_cols, s_rows = _canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    d_cols, d_rows = _canon([c[0] for c in cur.description], cur.fetchall())
    return (s_cols, s_rows), (d_cols, d_rows)
