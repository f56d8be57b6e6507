"""Side-by-side comparison of a query and its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (1, repr(v + 0.0))
    return (1, str(v))


def rows_of(frame) -> list[tuple]:
    cols = sorted(frame.column_names)
    return sorted(tuple(normal(v) for v in r) for r in zip(*(frame[c].to_pylist() for c in cols))), cols, [str(frame.schema.field(c).type) for c in cols]


def compared(spark_table, duck_table) -> str:
    """Empty if equal, else what differs."""
    a, ca, ta = rows_of(spark_table)
    b, cb, tb = rows_of(duck_table)
    if ca != cb:
        return f"columns {ca} {cb}"
    if ta != tb:
        return f"types {list(zip(ca, ta, tb))}"
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    if a != b:
        return f"values {[(x, y) for x, y in zip(a, b) if x != y][:3]}"
    return ""
