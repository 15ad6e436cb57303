"""Compare catalogue queries with their SQL statements run by DuckDB.

Mirrors the acceptance check: same column names, same row count, and the same
multiset of rows once columns are sorted by name and values are normalised.

    python -m quarry.plans.verify /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
from decimal import Decimal


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return format(Decimal(repr(round(v, 9))).normalize(), "f")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def _canon(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, out


def duck_views(con, base: str, names) -> None:
    for n in names:
        con.execute(f"CREATE OR REPLACE VIEW {n} AS SELECT * FROM read_parquet('{os.path.join(base, n)}.parquet')")


def compare(spark, con, base: str, name: str, query, sql: str) -> dict:
    t0 = time.time()
    df = query(spark, base)
    s_rows = [tuple(r) for r in df.collect()]
    s_cols = df.columns
    t1 = time.time()
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    sc, sr = _canon(s_cols, s_rows)
    dc, dr = _canon(d_cols, d_rows)
    res = {"name": name, "spark_sec": round(t1 - t0, 2), "rows": len(sr), "oracle_rows": len(dr),
           "cols_match": sc == dc, "rows_match": sr == dr}
    if not res["cols_match"]:
        res["spark_cols"], res["oracle_cols"] = sc, dc
    elif not res["rows_match"]:
        only_s = [r for r in sr if r not in set(dr)][:3]
        only_d = [r for r in dr if r not in set(sr)][:3]
        res["only_spark"], res["only_oracle"] = only_s, only_d
    return res


def main(argv: list[str]) -> int:
    import duckdb

    from quarry.plans.catalogue import QUERIES
    from quarry.plans.oracle import SQL
    from quarry.session import build_session
    from quarry.sources import DRIVER_TABLES

    base = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    duck_views(con, base, DRIVER_TABLES)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, base, n, QUERIES[n], SQL[n])
        except Exception as e:  # report and continue
            r = {"name": n, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        ok = r.get("cols_match") and r.get("rows_match")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
