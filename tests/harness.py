"""Rows of a query and of its SQL twin, in a form that compares."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c.sql(sql).df()


def plain(v):
    if v is None or str(v) == "<NA>" or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6) if not v.is_integer() or math.isinf(v) else int(v)
    return v


def rows(df) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)
