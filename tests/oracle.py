"""Compare a query with its SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return float(v) if type(v).__name__ == "Decimal" else v


def _close(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    return a == b


def differences(df, con, sql: str) -> list[str]:
    got = [[_plain(r[c]) for c in sorted(df.columns)] for r in df.collect()]
    names = [d[0] for d in con.execute(sql).description]
    rows = con.execute(sql).fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [[_plain(r[i]) for i in order] for r in rows]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows and {len(want)}"]
    key = lambda r: [(x is not None, str(type(x)) if not isinstance(x, int | float) else "", round(x, 6) if isinstance(x, float) else x) if x is not None else (False, "", "") for x in r]
    pairs = zip(sorted(got, key=lambda r: str(key(r))), sorted(want, key=lambda r: str(key(r))), strict=True)
    return [f"{a} and {b}" for a, b in pairs if not all(_close(x, y) for x, y in zip(a, b, strict=True))][:3]
