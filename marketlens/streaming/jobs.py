"""Stream jobs (T1-T8): event-time watermarks, tumbling/sliding windows,
update-mode statistics and append-mode arbitrage.

The batch operators are reused as is where Structured Streaming allows it
(statistics are one windowed aggregation).  Arbitrage is two chained
stateful aggregations: per (window, base, venue) sums, then per (window,
base) the best venues; the second groups by ``window(window_time(w), width)``
so that the watermark carries through and each window is emitted once, in
append mode, when the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from marketlens.functions.parse import parse_event_time
from marketlens.operators.arbitrage import MIN_ARBITRAGE_PCT, opportunity_metrics, prepare_trades
from marketlens.operators.stats import window_stats
from marketlens.sources.streams import SourceConfig, read_trades_stream, read_unified_stream
from marketlens.streaming.sinks import SinkConfig, write_arbitrage_stream, write_stats_stream

# Windows and watermarks of the reference jobs.
STATS_WIDTH, STATS_WATERMARK = "5 minutes", "10 minutes"
ARB_WIDTH, ARB_WATERMARK = "5 seconds", "30 seconds"


def with_event_time(df: DataFrame, col: str, delay: str) -> DataFrame:
    """Declare ``col`` the event time with a watermark ``delay``
    (TIMESTAMP_NTZ is cast to TIMESTAMP, which ``withWatermark`` requires)."""
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        df = df.withColumn(col, F.col(col).cast("timestamp"))
    return df.withWatermark(col, delay)


def stats_stream(ticks: DataFrame, width: str = STATS_WIDTH, slide: str | None = None,
                 watermark: str = STATS_WATERMARK, ts_col: str = "timestamp",
                 source: str = "all") -> DataFrame:
    """T1 + T3 + A1/A2 on a stream of ticks; rows later than the watermark
    are dropped (T7, visible as ``numRowsDroppedByWatermark``)."""
    return window_stats(with_event_time(ticks, ts_col, watermark), width, slide,
                        source=source, ts_col=ts_col)


def arbitrage_stream(unified: DataFrame, width: str = ARB_WIDTH,
                     watermark: str = ARB_WATERMARK, min_pct: float = MIN_ARBITRAGE_PCT,
                     allow: list[str] | None = None, symbol_mode: str | None = "suffix",
                     max_latency: float | None = None,
                     min_notional: float | None = None) -> DataFrame:
    """T2 + T4 + A4-A8 on a stream of unified trades (``timestamp`` ISO text
    or an ``event_time`` column)."""
    if "event_time" not in unified.columns:
        unified = unified.withColumn("event_time", parse_event_time("timestamp"))
    p = prepare_trades(unified, allow, symbol_mode, "event_time", max_latency)
    p = with_event_time(p, "event_time", watermark)
    venues = (p.groupBy(F.window("event_time", width).alias("w"), "base_symbol", "exchange")
               .agg(F.sum(F.col("price") * F.col("volume")).alias("total_value"),
                    F.sum("volume").alias("total_volume"), F.count("*").alias("trade_count")))
    venues = venues.withColumn("vwap", F.when(F.col("total_volume") > 0,
                                              F.col("total_value") / F.col("total_volume")))
    valid = F.col("vwap").isNotNull()
    key = F.when(valid, F.struct("vwap", "exchange"))
    venue = F.struct("exchange", "vwap", "total_volume")
    best = (venues.groupBy(F.window(F.window_time("w"), width).alias("w2"), "base_symbol")
                  .agg(F.sum("trade_count").alias("n_trades"),
                       F.count(F.when(valid, 1)).alias("n_venues"),
                       F.min_by(venue, key).alias("b"), F.max_by(venue, key).alias("s")))
    best = best.filter((F.col("n_trades") >= 2) & (F.col("n_venues") >= 2)).select(
        F.col("w2.start").alias("window_start"), F.col("w2.end").alias("window_end"),
        F.col("base_symbol").alias("symbol"),
        F.col("b.exchange").alias("buy_exchange"), F.col("b.vwap").alias("buy_price"),
        F.col("b.total_volume").alias("buy_volume"),
        F.col("s.exchange").alias("sell_exchange"), F.col("s.vwap").alias("sell_price"),
        F.col("s.total_volume").alias("sell_volume"))
    out = opportunity_metrics(best).filter(F.col("arbitrage_percentage") > F.lit(min_pct))
    if min_notional is not None:
        out = out.filter(F.col("potential_volume") * F.col("buy_price") >= F.lit(min_notional))
    return out


def run_stats_job(spark, source: SourceConfig, sink: SinkConfig, width: str = STATS_WIDTH,
                  watermark: str = STATS_WATERMARK):
    """The deployed statistics job: envelope topic -> 5-minute statistics ->
    keyed JSON in update mode (S1, P1, T1, T3, A1, A2, P16, S4, T5, T8)."""
    ticks = read_trades_stream(spark, source)
    return write_stats_stream(stats_stream(ticks, width, watermark=watermark), sink)


def run_arbitrage_job(spark, source: SourceConfig, sink: SinkConfig, width: str = ARB_WIDTH,
                      watermark: str = ARB_WATERMARK, allow: list[str] | None = None):
    """The arbitrage job: merged topic -> opportunities -> keyed JSON in
    append mode (S2, P9-P12, T2, T4, A4-A7, P17, S5, T6, T8)."""
    from marketlens.functions.normalize import DEFAULT_SYMBOLS
    unified = read_unified_stream(spark, source)
    arb = arbitrage_stream(unified, width, watermark,
                           allow=allow if allow is not None else DEFAULT_SYMBOLS)
    return write_arbitrage_stream(arb, sink)


def late_rows(query) -> int:
    """Rows dropped behind the watermark in the batches whose progress the
    query still keeps (``spark.sql.streaming.numRecentProgressUpdates``); the
    running total over all batches and restarts is ``progress.ProgressTotals``."""
    total = 0
    for p in query.recentProgress:
        for op in p["stateOperators"] or []:
            total += int(op["numRowsDroppedByWatermark"] or 0)
    return total
