"""Compare a query with its SQL, as sorted rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def as_rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    found = [tuple(plain(v.item() if hasattr(v, "item") else v) for v in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False)]
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


def sql_rows(sql: str, folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con.execute(sql).fetchdf()
