"""Spark-vs-DuckDB comparison used by the tests (order-insensitive)."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    """A value as both engines' Arrow tables give it, whatever the width of its type."""
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v if isinstance(v, (int, bool)) else str(v)


def multiset(table: pa.Table):
    """Column names and counted rows of an Arrow table; Arrow keeps nullable integers whole."""
    cols = sorted(table.column_names)
    return cols, Counter(zip(*(map(_norm, table.column(c).to_pylist()) for c in cols), strict=True))


def oracle_table(con, sql: str) -> pa.Table:
    """The result of DuckDB SQL as an Arrow table."""
    return con.sql(sql).to_arrow_table()
