"""Batch sources (S10) and the mapping of the driver tables to trades.

A *trades* DataFrame has the columns of ``TRADE_COLUMNS``::

    event_id BIGINT, symbol STRING, exchange STRING,
    price DOUBLE, volume DOUBLE, ts TIMESTAMP_NTZ

``events`` is the default source (unique ``event_id`` and ``ts``); the
``lineitem`` mapping is dense (many trades per symbol and day) and is used
by order-insensitive operators only, because its ``event_id`` repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE_COLUMNS = ["event_id", "symbol", "exchange", "price", "volume", "ts"]

# Venue names, in venue-id order (user_id % 3).
VENUES = ["binance", "coinbase", "kraken"]


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame (Parquet: pruning and pushdown).  Its
    files are listed on every call, so appended files are seen."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _venue(user_id):
    idx = F.pmod(user_id, F.lit(len(VENUES)))
    out = F.when(idx == 0, F.lit(VENUES[0]))
    for i, name in enumerate(VENUES[1:], start=1):
        out = out.when(idx == i, F.lit(name))
    return out


def trades_from_events(events: DataFrame) -> DataFrame:
    """events -> trades: symbol = upper(event_type), venue = user_id % 3,
    price = value, volume = event_id % 10 + 1, ts = ts."""
    return events.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.upper("event_type").alias("symbol"),
        _venue(F.col("user_id")).alias("exchange"),
        F.col("value").cast("double").alias("price"),
        (F.pmod(F.col("event_id"), F.lit(10)) + 1).cast("double").alias("volume"),
        F.col("ts"),
    )


def trades_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """lineitem -> dense trades: symbol = part, venue = supplier,
    price = unit price, volume = quantity, ts = ship date.

    ``event_id`` = ``l_orderkey * 8 + l_linenumber`` is *not* unique in the
    generated tables, so only order-insensitive operators use this source.
    """
    return lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("event_id"),
        F.col("l_partkey").cast("string").alias("symbol"),
        F.col("l_suppkey").cast("string").alias("exchange"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("double").alias("volume"),
        F.col("l_shipdate").alias("ts"),
    )


def load_trades(spark: SparkSession, sf_dir: str, source: str = "events") -> DataFrame:
    """Trades from the driver tables."""
    if source == "events":
        return trades_from_events(load_table(spark, sf_dir, "events"))
    if source == "lineitem":
        return trades_from_lineitem(load_table(spark, sf_dir, "lineitem"))
    raise ValueError(f"unknown trade source {source!r}")
