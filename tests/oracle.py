"""Runs queries beside their SQL and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def compare(spark, sf_dir: str, name: str, f, sql: str | None) -> str | None:
    got = f(spark, sf_dir)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    if sql is None:
        return None if rows else "no rows"
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    at = [names.index(c) for c in columns]
    plain = lambda r: tuple(float(x) + 0.0 if isinstance(x, float) else float(x) if type(x).__name__ == "Decimal" else x for x in r)
    a = sorted(map(plain, rows), key=repr)
    b = sorted((plain(tuple(r[i] for i in at)) for r in want.fetchall()), key=repr)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    same = lambda x, y: x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(same(p, q) for p, q in zip(x, y, strict=True))]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else None
