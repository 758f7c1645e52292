"""Registered queries: the streaming jobs, replayed over the given table.

Each query streams the Parquet files of ``events`` (or a table that Spark
derives from them) through a job with the ``availableNow`` trigger, waits for
it, and returns the table that the job's sink wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import alerts as al
from marketlens.operators import rules as ru
from marketlens.operators.indicators import INDICATOR_COLUMNS
from marketlens.plans.common import TRADES_CTE, load_table, load_trades, r6, stats_cte
from marketlens.plans.q_alerts import _FIRST_SQL, derive_alerts
from marketlens.plans.q_arbitrage import _FL, _arb_sql
from marketlens.plans.q_indicators import _ind_cte, _round_sql
from marketlens.plans.q_serving import _LATEST, _STATS
from marketlens.plans.registry import register
from marketlens.session import scratch_dir
from marketlens.sources.tables import trades_from_events
from marketlens.streaming import jobs, sinks, stateful
from marketlens.streaming.progress import ProgressTotals

NOW = {"availableNow": True}


FILES = 10     # bounded files of a replay, one micro-batch each


def _stream(spark, path: str, files: int | None = None):
    """The files of a Parquet table as a file stream, ``files`` a micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _trade_stream(spark, sf_dir):
    # a file source streams folders: the table is written to one, event by event
    path = scratch_dir(spark, "events")
    load_table(spark, sf_dir, "events").write.parquet(path)
    return trades_from_events(_stream(spark, path))


class _Replay:
    """A table as a folder of ``files`` bounded files that arrive in the order of
    ``order``, some of them only after a first run: ``arrive`` writes the next ones."""

    def __init__(self, df, order: list[str], files: int = FILES, part: str | None = None):
        self.spark, self.files, self.written = df.sparkSession, files, 0
        self.path, staged = scratch_dir(self.spark, "replay"), scratch_dir(self.spark, "staged")
        # range parts, so a file holds a stretch of time, whatever the symbols; or one for each value of ``part``
        parts = df.repartitionByRange(files, *order).withColumn("_file", F.spark_partition_id() if part is None else F.col(part))
        # a folder for each: a file that arrives is read alone, not picked out of the whole table
        parts.sortWithinPartitions("_file", *order).write.partitionBy("_file").parquet(staged)
        self.staged = self.spark.read.schema(parts.schema).parquet(staged)
        if part is not None:
            self.files = self.staged.agg(F.max("_file")).first()[0] + 1
        self.schema = df.schema

    def arrive(self, n: int) -> None:
        # a file source goes by the files' times: one after another
        for k in range(self.written, min(self.files, self.written + n)):
            self.staged.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(self.path)
        self.written += n

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    def run(self, start) -> None:
        """Starts the query on half the files, stops, and goes on from its checkpoint with the rest."""
        for n in (self.files // 2, self.files - self.files // 2):
            self.arrive(n)
            start(self.stream()).awaitTermination()


def _sink(spark, fmt: str = "parquet") -> sinks.SinkConfig:
    out = scratch_dir(spark, "out")
    return sinks.SinkConfig(format=fmt, path=out + "/table", checkpoint=out + "/checkpoint", trigger=NOW)


def _utc(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


_CLOSED = "window_end <= (SELECT max(ts) FROM trades) - INTERVAL '{}'"


@register("stream_stats_closed_windows", f"""
WITH {TRADES_CTE},
{stats_cte('5 minutes')}
SELECT symbol, window_start, window_end, round(avg_price, 6) AS avg_price, min_price, max_price,
       trade_count, round(volatility, 6) AS volatility, round(trend, 6) AS trend
FROM stats WHERE {_CLOSED.format('10 minutes')}""")
def q_stream_stats(spark, sf_dir):
    """Appended once the watermark has passed a window."""
    cfg = _sink(spark)
    s = jobs.stats_stream(_trade_stream(spark, sf_dir), ts_col="ts")
    sinks._start(s, cfg, "append", "stats").awaitTermination()
    return r6(_utc(spark.read.parquet(cfg.path), "window_start", "window_end"), _STATS)


@register("stream_latest_stats", f"""
WITH {TRADES_CTE},
{_LATEST}
SELECT symbol, window_start, window_end, round(avg_price, 6) AS avg_price, min_price, max_price,
       trade_count, round(volatility, 6) AS volatility, round(trend, 6) AS trend FROM latest""")
def q_stream_latest(spark, sf_dir):
    """Update mode into the latest row per symbol."""
    cfg = _sink(spark)
    s = jobs.stats_stream(_trade_stream(spark, sf_dir), ts_col="ts")
    (s.writeStream.outputMode("update").option("checkpointLocation", cfg.checkpoint).trigger(**NOW)
      .foreachBatch(sinks.upsert_latest(cfg.path)).start().awaitTermination())
    return r6(_utc(sinks.read_latest(spark, cfg.path), "window_start", "window_end"), _STATS)


@register("stream_arbitrage_closed_windows", f"""
SELECT * FROM ({_arb_sql('1 hour')}) WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL '30 seconds'""")
def q_stream_arbitrage(spark, sf_dir):
    """Opportunities appended once."""
    cfg = _sink(spark)
    t = _trade_stream(spark, sf_dir).withColumnRenamed("ts", "event_time")
    arb = jobs.arbitrage_stream(t, width="1 hour", symbol_mode=None)
    sinks.write_arbitrage_stream(arb, cfg, as_kv=False).awaitTermination()
    out = _utc(spark.read.parquet(cfg.path), "window_start", "window_end")
    return r6(out.select("symbol", "window_start", "window_end", "buy_exchange", "sell_exchange", *_FL), _FL)


_IND_SQL = f"""
WITH {_ind_cte()}
SELECT event_id, symbol, price, {_round_sql(['rsi', 'macd_line', 'signal_line', 'macd_histogram', 'upper_band', 'lower_band', 'bb_position'])}
FROM e WHERE price IS NOT NULL"""


def _ticks(trades):
    return trades.select("symbol", F.col("ts").cast("timestamp").alias("timestamp"), "event_id", "price")


def _rounded_indicators(df):
    cols = [c for c in INDICATOR_COLUMNS if c in ("rsi", "macd_line", "signal_line", "macd_histogram", "upper_band", "lower_band", "bb_position")]
    out = r6(df.select("event_id", "symbol", "price", *cols), cols)
    # numpy's means may leave a negative zero where an exact zero is due
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in cols})


@register("stream_indicators", _IND_SQL)
def q_stream_indicators(spark, sf_dir):
    """Indicators of a stream of ticks, ten bounded files, stopped and restarted after half of them."""
    cfg = _sink(spark)
    replay = _Replay(_ticks(load_trades(spark, sf_dir)), ["timestamp", "event_id"])
    replay.run(lambda ticks: sinks.write_keyed_stream(stateful.stream_indicators(ticks), cfg, "indicators"))
    return _rounded_indicators(spark.read.parquet(cfg.path))


@register("stream_indicators_watermark", _IND_SQL + " AND ts < (SELECT max(ts) FROM trades) - INTERVAL '2 days'")
def q_stream_indicators_watermark(spark, sf_dir):
    """T9 with a watermark: every file is out of order (by event id inside a day), and
    so are neighbouring files; closed minutes come out as in the batch."""
    cfg = _sink(spark)
    ticks = _ticks(load_trades(spark, sf_dir))
    # shuffled within each day: files arrive by day, then by a hash of the id
    mixed = ticks.withColumns({"_day": F.date_trunc("day", "timestamp"), "_mix": F.xxhash64("event_id")})
    replay = _Replay(mixed, ["_day", "_mix"])
    replay.run(lambda s: sinks.write_keyed_stream(stateful.stream_indicators(s.drop("_day", "_mix"), watermark="1 day", slot_ms=6 * 3_600_000), cfg, "indicators"))
    last = ticks.agg(F.max("timestamp")).select(F.col("max(timestamp)") - F.expr("interval 2 days")).scalar()
    return _rounded_indicators(spark.read.parquet(cfg.path).where(F.col("timestamp") < last))


@register("stream_alert_latch", f"""
WITH {_FIRST_SQL}
SELECT id, trigger_ts, trigger_event_id FROM fired""")
def q_stream_latch(spark, sf_dir):
    """First triggers on a stream of state updates, several micro-batches, stopped
    and restarted on the way."""
    t, cfg = load_trades(spark, sf_dir), _sink(spark)
    updates = al.state_timeline(t).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", *al.STATE_FIELDS)
    replay = _Replay(updates, ["ts", "event_id"], files=6)
    alerts = scratch_dir(spark, "registry")
    derive_alerts(t).write.parquet(alerts)
    replay.run(lambda s: sinks.write_keyed_stream(stateful.stream_alert_latch(s, spark.read.parquet(alerts)), cfg, "latch"))
    return _utc(spark.read.parquet(cfg.path), "trigger_ts")


EVERY = 1000


@register("stream_progress", f"""
WITH {TRADES_CTE}
SELECT count(*) AS messages, count(*) // {EVERY} AS reports, arg_max(symbol, ts) AS last_symbol, arg_max(price, ts) AS last_price FROM trades""")
def q_stream_progress(spark, sf_dir):
    """Message counters added up batch by batch, over a restart."""
    cfg = _sink(spark)
    replay = _Replay(_ticks(load_trades(spark, sf_dir)), ["timestamp", "event_id"])
    for n in (4, FILES - 4):
        replay.arrive(n)
        with ProgressTotals(spark, cfg.checkpoint + "-totals", every=EVERY) as totals:
            query = sinks._start(sinks.observe_trades(replay.stream()), cfg, "append", "progress")
            totals.finish(totals.follow(query))
    return totals.table().select("messages", "reports", "last_symbol", "last_price")


DAYS, MOST_DAYS = 3, 60     # days of trades a file


def _late_file(ts, first, last):
    """The file that the trades of a time arrive in, for a table from day ``first`` to ``last``:
    ten files of as many days, but at least ``DAYS`` (as the first two have) and at most
    ``MOST_DAYS``: two files must end well before what was sent 400 days late."""
    day = F.datediff(F.date_trunc("day", ts), first)
    days = F.least(F.lit(MOST_DAYS), F.greatest(F.lit(DAYS), F.ceil((F.datediff(last, first) + 1 - 2 * DAYS) / (FILES - 2))))
    return F.when(day < 2 * DAYS, F.floor(day / DAYS)).otherwise(2 + F.floor((day - 2 * DAYS) / days)).cast("int")


@register("stream_late_rows", f"""
WITH {TRADES_CTE},
first AS (SELECT min(date_trunc('day', ts)) AS day FROM trades)
SELECT count(*) AS late_rows FROM trades, first WHERE event_id % 25 = 0 AND date_diff('day', day, date_trunc('day', ts)) >= 6""")
def q_stream_late(spark, sf_dir):
    """Every 25th trade is sent again with a time long past, three days of trades a
    file or more (``_late_file``): all such rows are late but those of the first two files (a batch drops what
    was late when the one before it began).  Each falls into a window of its own, so none are combined before they are counted."""
    cfg = _sink(spark)
    t = load_trades(spark, sf_dir).select("symbol", "ts", "event_id", "price")
    first, last = (t.agg(end(F.date_trunc("day", "ts"))).scalar() for end in (F.min, F.max))
    arrival = _late_file("ts", first, last)
    again = t.where("event_id % 25 = 0").withColumns({"file": arrival, "ts": F.date_trunc("day", "ts") - F.make_dt_interval(F.lit(400), mins=F.col("event_id") * 5)})
    sent = t.withColumn("file", arrival).unionByName(again)
    replay = _Replay(sent.withColumn("ts", F.col("ts").cast("timestamp")), ["ts", "event_id"], part="file")
    for n in (5, replay.files):
        replay.arrive(n)
        with ProgressTotals(spark, cfg.checkpoint + "-totals") as totals:
            stats = jobs.stats_stream(replay.stream().drop("file"), ts_col="ts")
            totals.finish(totals.follow(sinks.write_stats_stream(stats, cfg)))
    return totals.table().select("late_rows")


@register("stream_stats_records", f"""
WITH {TRADES_CTE},
{stats_cte('1 hour')}
SELECT symbol, window_start, window_end, round(avg_price, 6) AS avg_price, min_price, max_price,
       trade_count, round(coalesce(volatility, 0), 6) AS volatility, round(coalesce(trend, 0), 6) AS trend FROM stats""")
def q_stream_records(spark, sf_dir):
    """The keyed JSON records of an update-mode stream that stops and goes
    on from its checkpoint; a window's last record is its statistics."""
    from marketlens.schemas import STATS_MESSAGE
    cfg = _sink(spark)
    replay = _Replay(load_trades(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), ["ts", "event_id"])
    replay.run(lambda s: sinks.write_stats_stream(jobs.stats_stream(s, width="1 hour", ts_col="ts"), cfg))
    sent = spark.read.parquet(cfg.path).select("batch_id", F.from_json("value", STATS_MESSAGE).alias("m"))
    last = sent.groupBy("m.symbol", "m.window_start").agg(F.max_by("m", "batch_id").alias("m")).select("m.*")
    numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("avg_price", "min_price", "max_price", "volatility", "trend")}
    out = last.withColumns(numbers | {"trade_count": F.col("trade_count").cast("long")} | {c: F.col(c).cast("timestamp") for c in ("window_start", "window_end")})
    return r6(_utc(out, "window_start", "window_end"), ["avg_price", "volatility", "trend"])


@register("stream_alert_records", f"""
WITH {TRADES_CTE},
{stats_cte('1 hour')}
SELECT 'high_volatility' AS rule_name, symbol, 'HIGH' AS severity, count(*) AS n FROM stats
WHERE round(volatility, 6) > 0.05 GROUP BY symbol""")
def q_stream_alerts(spark, sf_dir):
    """Rules on every micro-batch of a stream, written as alert records."""
    cfg = _sink(spark)
    s = r6(jobs.stats_stream(_trade_stream(spark, sf_dir), width="1 hour", ts_col="ts"), _STATS)
    sinks.write_alerts_stream(s, cfg).awaitTermination()
    out = spark.read.parquet(cfg.path)
    return out.groupBy("rule_name", "symbol", "severity").agg(F.count("*").alias("n"))


@register("alert_topic_records", f"""
WITH {TRADES_CTE},
{stats_cte('1 hour')}
SELECT 'binance-alerts' AS topic, symbol AS key, 'high_volatility' AS rule_name, 'HIGH' AS severity,
       strftime(window_end, '%Y-%m-%d %H:%M:%S') AS at, round(volatility, 6) AS volatility
FROM stats WHERE round(volatility, 6) > 0.05""")
def q_alert_topic(spark, sf_dir):
    """Alert records as keyed topic messages, read back from their JSON."""
    from marketlens.operators.stats import window_stats
    s = r6(window_stats(load_trades(spark, sf_dir), "1 hour"), _STATS)
    kv = sinks.alerts_to_kafka(ru.evaluate_rules(s, timestamp=F.col("window_end")), "binance-alerts")
    field = lambda p: F.get_json_object("value", p)
    return kv.select("topic", "key", field("$.rule_name").alias("rule_name"), field("$.severity").alias("severity"), field("$.timestamp").alias("at"),
                     F.get_json_object(field("$.data"), "$.volatility").cast("double").alias("volatility"))
