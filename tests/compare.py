"""Run registered queries against their SQL in DuckDB and compare values regardless of order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-5)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    left = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    rel = con.execute(sql)
    have = [d[0] for d in rel.description]
    if sorted(have) != names:
        return f"columns {names} and {sorted(have)}"
    at = [have.index(c) for c in names]
    right = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    if len(left) != len(right):
        return f"{len(left)} rows and {len(right)}"
    key = lambda r: tuple((x is not None, str(type(x)), str(round(x, 3) if isinstance(x, float) else x)) for x in r)
    for a, b in zip(sorted(left, key=key), sorted(right, key=key)):
        if not close(a, b):
            return f"{names}: {a} and {b}"
    return None
