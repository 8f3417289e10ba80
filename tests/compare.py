"""Run a query and its SQL and compare rows as a multiset, floats to nine digits."""

import datetime
import decimal
import math

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, int):
        return float(f"{float(x):.9g}") if abs(x) < 1 << 53 else x
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if isinstance(x, dict):
        return tuple(sorted((k, cell(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return bytes(x) if isinstance(x, bytearray) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, sf: str) -> str:
    """Empty where both agree."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = rows_of(names, got.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(have):
        return f"{len(have)} rows, SQL has {len(want)}"
    odd = [(h, w) for h, w in zip(have, want, strict=True) if h != w]
    return f"{len(odd)} of {len(have)} rows differ, such as {odd[0]}" if odd else ""
