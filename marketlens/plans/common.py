"""Shared helpers for registered queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.rounding import half_up
from marketlens.sources.tables import load_trades, load_table  # noqa: F401

# DuckDB form of ``trades_from_events`` (kept textually next to the Spark one
# so that both sides read the same table the same way).
TRADES_CTE = """trades AS (
  SELECT CAST(event_id AS BIGINT) AS event_id,
         upper(event_type) AS symbol,
         CASE user_id % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'coinbase' ELSE 'kraken' END AS exchange,
         CAST(value AS DOUBLE) AS price,
         CAST(event_id % 10 + 1 AS DOUBLE) AS volume,
         ts
  FROM events)"""

LINEITEM_TRADES_CTE = """ltrades AS (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS event_id,
         CAST(l_partkey AS VARCHAR) AS symbol,
         CAST(l_suppkey AS VARCHAR) AS exchange,
         CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS price,
         CAST(l_quantity AS DOUBLE) AS volume,
         l_shipdate AS ts
  FROM lineitem)"""


def stats_cte(width_sql: str, name: str = "stats", source: str = "trades") -> str:
    """DuckDB form of ``window_stats`` + ``with_trend`` (unrounded)."""
    return f"""{name} AS (
  SELECT symbol,
         time_bucket(INTERVAL '{width_sql}', ts) AS window_start,
         time_bucket(INTERVAL '{width_sql}', ts) + INTERVAL '{width_sql}' AS window_end,
         avg(price) AS avg_price, min(price) AS min_price, max(price) AS max_price,
         count(price) AS trade_count, stddev_samp(price) AS volatility,
         (max(price) - min(price)) / nullif(avg(price), 0) * 100 AS trend
  FROM {source} WHERE ts IS NOT NULL
  GROUP BY symbol, time_bucket(INTERVAL '{width_sql}', ts))"""


def r6(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Round the given float columns (comparison normalisation) the way
    DuckDB's ``round`` does (binary value, half away from zero)."""
    return df.select(*[half_up(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])
