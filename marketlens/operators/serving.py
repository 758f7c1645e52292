"""Serving queries over trades and statistics: latest / recent / overview
(A9-A16, O1-O5).

Top-k is written the way Catalyst turns into bounded-memory plans:
``orderBy(...).limit(n)`` becomes TakeOrderedAndProject (a per-partition
top-n, then one merge of n rows per partition), and ``row_number() <= n``
per key gets a WindowGroupLimit below the shuffle, so at most n rows per key
and partition are shuffled even for a hot symbol.  "Latest per key" is
``max_by`` over whole rows: a sort aggregate (rows are no mutable buffer) that
combines before the shuffle, so one row per key and partition is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.rounding import half_up

from marketlens.operators.stats import STATS_COLUMNS

# Fixed values from the reference's in-memory buffers.
TRADE_BUFFER = 100        # most recent trades kept by the API
PRICE_HISTORY = 50        # ticks per coin kept by the dashboard


def _latest_by(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    cols = df.columns
    order = F.struct(*[F.col(c) for c in order_cols])
    row = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(key)
              .agg(F.max_by(row, order).alias("_r"))
              .select(*[F.col("_r." + c).alias(c) for c in cols]))


def latest_stats(stats: DataFrame) -> DataFrame:
    """Latest statistics row per symbol (greatest ``window_end``, Q11)."""
    return _latest_by(stats, "symbol", ["window_end", "window_start"])


def latest_trade(t: DataFrame) -> DataFrame:
    """A10: latest trade per symbol by ``(ts, event_id)``.

    In steps on plain numbers, which hash aggregates hold in place: the latest
    time of each symbol from two columns of the table; the trades since the
    earliest of these times (a filter that reaches the scan); of those the ones of their
    symbol's latest time, then of its greatest id (of equal ones the one of
    the greatest hash).  Nothing is sorted, and a table whose symbols all
    trade reads little more than its end.
    """
    times = t.groupBy("symbol").agg(F.max("ts").alias("_last"))
    least = times.agg(F.min("_last").alias("l")).scalar()
    # symbols without any time keep their rows
    cur = t.filter((F.col("ts") >= least) | F.col("ts").isNull()).withColumn("_hash", F.xxhash64(*t.columns))
    for c in ("ts", "event_id", "_hash"):
        top = (times if c == "ts" else cur.groupBy("symbol").agg(F.max(c).alias("_last"))).withColumnRenamed("symbol", "_key")
        same = F.col("symbol").eqNullSafe(F.col("_key")) & F.col(c).eqNullSafe(F.col("_last"))
        cur = cur.join(top.hint("shuffle_hash"), same, "left_semi")
    return cur.drop("_hash").distinct()


def symbols(stats: DataFrame) -> DataFrame:
    """Distinct symbols, with their count on every row."""
    d = stats.select("symbol").distinct()
    # count as a scalar subquery: no single-partition window, no cross join
    return d.withColumn("symbol_count", d.agg(F.count("*")).scalar())


def recent_trades(t: DataFrame, n: int = TRADE_BUFFER) -> DataFrame:
    """O1: the n most recent trades overall (newest first)."""
    return t.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def recent_per_symbol(t: DataFrame, n: int = PRICE_HISTORY,
                      key: str = "symbol") -> DataFrame:
    """O2: the n most recent trades of each symbol, with ``pos`` 1 = newest."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return t.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


def list_trades(t: DataFrame, limit: int = 50, symbol: str | None = None,
                variant: str = "A", buffer: int = TRADE_BUFFER) -> DataFrame:
    """O3: trade listing inside the 100-row buffer.

    Variant A takes the last ``limit`` trades, then filters by symbol;
    variant B filters first, then takes the last ``limit``.
    """
    buf = recent_trades(t, buffer)
    if variant == "A":
        out = recent_trades(buf, limit)
        return out.filter(F.col("symbol") == symbol) if symbol else out
    if variant == "B":
        out = buf.filter(F.col("symbol") == symbol) if symbol else buf
        return recent_trades(out, limit)
    raise ValueError("variant must be 'A' or 'B'")


def list_stats(stats: DataFrame, symbol: str | None = None) -> DataFrame:
    """Latest statistics, optionally for one symbol."""
    return latest_stats(stats.filter(F.col("symbol") == symbol) if symbol else stats)


def snapshot(t: DataFrame, stats: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Welcome snapshot = last n trades (10 in A, 20 in B) + latest stats."""
    return recent_trades(t, n), latest_stats(stats)


def symbol_trades(t: DataFrame, symbol: str, variant: str = "A") -> DataFrame:
    """A12's trade list: the symbol's trades among the last 50 (A), or its
    last 10 among the 100 buffered ones (B)."""
    if variant == "A":
        return recent_trades(t, 50).filter(F.col("symbol") == symbol)
    if variant == "B":
        return recent_trades(recent_trades(t, TRADE_BUFFER).filter(F.col("symbol") == symbol), 10)
    raise ValueError("variant must be 'A' or 'B'")


def symbol_detail(stats: DataFrame, t: DataFrame, symbol: str,
                  variant: str = "A") -> DataFrame:
    """One row for ``symbol`` or none when not found.

    A: latest stats + the symbol's trades among the last 50 overall, with
    ``trades_count``, ``recent_avg_price`` (0 if none), ``total_volume``;
    not found without stats.  B: the symbol's last 10 of the 100 buffered
    trades summarised the same way; not found when it has neither stats nor
    trades.  ``symbol_trades`` lists the trades themselves.
    """
    st = latest_stats(stats.filter(F.col("symbol") == symbol))
    recent = symbol_trades(t, symbol, variant)
    agg = recent.agg(F.count("*").alias("trades_count"),
                     F.coalesce(F.avg("price"), F.lit(0.0)).alias("recent_avg_price"),
                     F.coalesce(F.sum("volume"), F.lit(0.0)).alias("total_volume"))
    agg = agg.withColumn("symbol", F.lit(symbol))
    stat_cols = [c for c in STATS_COLUMNS if c != "symbol" and c in st.columns]
    out = agg.join(st, "symbol", "left")
    if variant == "A":
        out = out.filter(F.col("window_end").isNotNull())
    else:
        out = out.filter(F.col("window_end").isNotNull() | (F.col("trades_count") > 0))
    return out.select("symbol", *stat_cols, "trades_count", "recent_avg_price", "total_volume")


def market_overview(stats: DataFrame, t: DataFrame, variant: str = "A",
                    buffer: int = TRADE_BUFFER) -> DataFrame:
    """One row per symbol with latest statistics.

    A: ``volume`` = the symbol's rows among the last 100 trades.
    B: ``volume`` = ``trade_count``, plus ``last_update`` = ``window_end``.
    """
    st = latest_stats(stats)
    base = st.select("symbol",
                     F.col("avg_price").alias("current_price"),
                     F.col("trend").alias("change_24h"),
                     "volatility",
                     F.col("max_price").alias("high"),
                     F.col("min_price").alias("low"),
                     "trade_count", "window_end")
    if variant == "A":
        counts = recent_trades(t, buffer).groupBy("symbol").agg(F.count("*").alias("volume"))
        return (base.join(counts, "symbol", "left")
                    .select("symbol", "current_price", "change_24h", "volatility",
                            F.coalesce("volume", F.lit(0)).cast("bigint").alias("volume"),
                            "high", "low"))
    if variant == "B":
        return base.select("symbol", "current_price", "change_24h",
                           F.col("trade_count").alias("volume"), "volatility",
                           F.col("high").alias("high_24h"), F.col("low").alias("low_24h"),
                           F.col("window_end").alias("last_update"))
    raise ValueError("variant must be 'A' or 'B'")


def live_stats(t: DataFrame, k: int = PRICE_HISTORY) -> DataFrame:
    """Dashboard statistics over each symbol's last k non-zero ticks:
    avg/min/max rounded to 2, count, range volatility ``(max-min)/avg*100``
    rounded to 2."""
    last = recent_per_symbol(t.filter(F.col("price") != 0), k)
    g = last.groupBy("symbol").agg(F.avg("price").alias("a"), F.min("price").alias("lo"),
                                   F.max("price").alias("hi"), F.count("*").alias("n"))
    return g.select("symbol",
                    half_up("a", 2).alias("avg"), half_up("lo", 2).alias("min"),
                    half_up("hi", 2).alias("max"),
                    half_up(F.try_divide(F.col("hi") - F.col("lo"), F.col("a")) * 100, 2)
                     .alias("volatility"),
                    F.col("n").alias("count"))


def chart_bounds(t: DataFrame, k: int = PRICE_HISTORY) -> DataFrame:
    """Chart axis bounds over the last k ticks: ``min*0.9995``, ``max*1.0005``."""
    last = recent_per_symbol(t.filter(F.col("price") != 0), k)
    return last.groupBy("symbol").agg(
        (F.min("price") * 0.9995).alias("suggested_min"),
        (F.max("price") * 1.0005).alias("suggested_max"))


def health(t: DataFrame, stats: DataFrame, alerts: DataFrame | None = None,
           buffer: int = TRADE_BUFFER) -> DataFrame:
    """One row of counts: buffered trades (at most the buffer size),
    symbols with statistics, registered alerts."""
    n_alerts = (alerts.agg(F.count("*")).scalar() if alerts is not None
                else F.lit(0).cast("bigint"))
    return t.agg(F.least(F.count("*"), F.lit(buffer)).cast("bigint").alias("buffered_trades")) \
            .select("buffered_trades",
                    stats.agg(F.countDistinct("symbol")).scalar().alias("symbols_with_stats"),
                    n_alerts.alias("active_alerts"))
