"""Spark result against DuckDB result, as multisets of rows with columns sorted by name."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return int(value) if value == int(value) else value
    if isinstance(value, datetime.datetime):
        return value.date().isoformat() if value.time() == datetime.time(0) else value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(frame, con, sql, show=3):
    """Empty when both agree, else a text that says how they differ."""
    result = con.execute(sql)
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    ours = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if ours[1] != theirs[1]:
        extra, lacking = ours[1] - theirs[1], theirs[1] - ours[1]
        return (f"{sum(ours[1].values())} rows against {sum(theirs[1].values())}; {ours[0]}; "
                f"only Spark {list(extra)[:show]}; only SQL {list(lacking)[:show]}")
    return ""
