"""Stream sinks (S4-S8, S11) and the latest-per-symbol upsert.

Kafka sinks go through Spark's own connector (``format("kafka")``), which
must be on the classpath at submit time; tests use memory / file /
``foreachBatch`` sinks through the same functions.  Every query gets a
checkpoint folder under the shared ``spark.checkpoint.dir`` unless one is
given, so offsets, state and the watermark survive executor and driver loss.
"""

from __future__ import annotations

import os
import threading
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlens.functions.parse import arbitrage_to_kv, stats_to_kv
from marketlens.session import checkpoint_dir


@dataclass
class SinkConfig:
    """Where a stream goes.  Topic names default to the reference's
    environment variables."""
    format: str = "kafka"
    topic: str | None = None
    bootstrap_servers: str = field(
        default_factory=lambda: os.getenv("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"))
    checkpoint: str | None = None
    path: str | None = None
    query_name: str | None = None
    trigger: dict = field(default_factory=dict)     # e.g. {"availableNow": True}
    options: dict = field(default_factory=dict)


def _checkpoint(df: DataFrame, cfg: SinkConfig, default_name: str) -> str:
    if cfg.checkpoint:
        return cfg.checkpoint
    # without a folder of its own a stream uses the shared one, under a fixed
    # name, so that a restarted job finds its offsets and state again
    base = checkpoint_dir(df.sparkSession)
    return f"{base.rstrip('/')}/streams/{cfg.query_name or default_name}"


def _start(df: DataFrame, cfg: SinkConfig, mode: str, default_name: str,
           default_topic: str | None = None) -> StreamingQuery:
    w = df.writeStream.outputMode(mode).option("checkpointLocation",
                                                _checkpoint(df, cfg, default_name))
    if cfg.query_name:
        w = w.queryName(cfg.query_name)
    if cfg.trigger:
        w = w.trigger(**cfg.trigger)
    for k, v in cfg.options.items():
        w = w.option(k, v)
    if cfg.format == "kafka":
        w = (w.format("kafka").option("kafka.bootstrap.servers", cfg.bootstrap_servers)
              .option("topic", cfg.topic or default_topic))
        return w.start()
    if cfg.format == "memory":
        return w.format("memory").queryName(cfg.query_name or default_name).start()
    if cfg.format in ("parquet", "json") and mode == "update":
        # file sinks only append: a folder for each batch, which a replay replaces
        return w.foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").format(cfg.format)
                              .save(f"{cfg.path.rstrip('/')}/batch_id={batch_id}")).start()
    if cfg.format in ("parquet", "json"):
        return w.format(cfg.format).start(cfg.path)
    raise ValueError(f"unsupported sink format {cfg.format!r}")


STORE = "spark.sql.streaming.stateStore.providerClass"
PLAIN_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_store_lock = threading.RLock()


@contextmanager
def keyed_state(spark):
    """Streams started inside have a state store with column families, as
    ``transformWithState`` needs: Spark's default has none, and the session need not be
    ours.  A stream keeps the settings that hold when it starts, so the session gets its
    own back; another store that it names stays."""
    with _store_lock:
        own = spark.conf.get(STORE, None)
        plain = own is None or own.endswith(PLAIN_STORE.rsplit(".", 1)[1])
        if plain:
            spark.conf.set(STORE, ROCKSDB_STORE)
        try:
            yield
        finally:
            if plain:
                spark.conf.unset(STORE) if own is None else spark.conf.set(STORE, own)


def write_keyed_stream(df: DataFrame, cfg: SinkConfig, default_name: str) -> StreamingQuery:
    """The rows of ``stateful`` operators in **append** mode, whatever state store
    the session has set."""
    with keyed_state(df.sparkSession):
        return _start(df, cfg, "append", default_name)


def write_stats_stream(stats: DataFrame, cfg: SinkConfig, as_kv: bool = True) -> StreamingQuery:
    """S4 (+T5): statistics as keyed JSON records in **update** mode: each
    micro-batch re-emits every window it touched."""
    out = stats_to_kv(stats) if as_kv else stats
    return _start(out, cfg, "update", "stats",
                  os.getenv("KAFKA_TOPIC_AGG", "binance-agg"))


def write_arbitrage_stream(arb: DataFrame, cfg: SinkConfig, as_kv: bool = True) -> StreamingQuery:
    """S5 (+T6): opportunities as keyed JSON records in **append** mode: a
    window is emitted once, after the watermark passes its end."""
    out = arbitrage_to_kv(arb) if as_kv else arb
    return _start(out, cfg, "append", "arbitrage",
                  os.getenv("KAFKA_TOPIC_ARBITRAGE", "arbitrage-opportunities"))


RECORD_ID = "record-id"


def alerts_to_kafka(alerts: DataFrame, topic: str | None = None, batch: str | None = None) -> DataFrame:
    """Alert rows -> Kafka records ``(topic, key=symbol, value=JSON)``.

    With ``batch`` (a name of the query and its micro-batch) each record has the
    header ``record-id``: the batch, a digest of the rule and the row it fired on, and
    a number among equal ones.  A batch that runs again gives the same ids, whatever the order
    of its rows and the time of evaluation; see ``unique_records``."""
    if batch is not None:
        digest = F.sha1(F.to_json(F.struct("rule_name", "symbol", "data")))
        nth = F.row_number().over(Window.partitionBy("_digest").orderBy("_digest"))
        alerts = alerts.withColumn("_digest", digest).withColumn("_id", F.concat_ws(":", F.lit(batch), "_digest", nth))
    t = topic or os.getenv("KAFKA_TOPIC_ALERTS", "binance-alerts")
    value = F.to_json(F.struct("rule_name", "symbol", "message", "severity",
                               F.col("timestamp").cast("string").alias("timestamp"),
                               "data", "channels"))
    record = [F.lit(t).alias("topic"), F.col("symbol").cast("string").alias("key"), value.alias("value")]
    if batch is not None:
        record.append(F.array(F.struct(F.lit(RECORD_ID).alias("key"), F.col("_id").cast("binary").alias("value"))).alias("headers"))
    return alerts.select(*record)


def unique_records(records: DataFrame, watermark: str | None = None) -> DataFrame:
    """Records with ``headers`` (read with ``includeHeaders``), each ``record-id`` once;
    records without one all stay.  On a stream give ``watermark`` on ``timestamp``: copies
    within it are dropped, and ids are forgotten after it."""
    own = F.get(F.filter("headers", lambda h: h["key"] == RECORD_ID), F.lit(0))["value"].cast("string")
    named = records.withColumn("_id", own)
    if watermark is None:
        first = Window.partitionBy("_id").orderBy("_id")
        kept = named.where("_id is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        return kept.unionByName(named.where("_id is null")).drop("_id")
    named = named.withColumn("_id", F.coalesce("_id", F.uuid()))
    return named.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["_id"]).drop("_id")


def write_alerts_stream(df: DataFrame, cfg: SinkConfig, rules=None) -> StreamingQuery:
    """Evaluate the rules on every micro-batch and write the alert
    records.  The batch is never collected: ``evaluate_rules`` is a
    distributed projection and the write is a distributed Kafka / file write.
    """
    from marketlens.operators.rules import evaluate_rules

    def run(batch: DataFrame, batch_id: int):
        alerts = evaluate_rules(batch, rules)
        if cfg.format == "kafka":
            # written again on a replay, with the ids that the records had before
            name = f"{cfg.query_name or 'alerts'}:{batch_id}"
            (alerts_to_kafka(alerts, cfg.topic, name).write.format("kafka").option("includeHeaders", "true")
             .option("kafka.bootstrap.servers", cfg.bootstrap_servers).save())
        else:
            # idempotent on replay: one folder per batch id, overwritten
            alerts.write.mode("overwrite").format(cfg.format or "parquet").save(
                f"{cfg.path.rstrip('/')}/batch_id={batch_id}")

    w = df.writeStream.foreachBatch(run).option(
        "checkpointLocation", _checkpoint(df, cfg, "alerts")).outputMode("update")
    if cfg.trigger:
        w = w.trigger(**cfg.trigger)
    if cfg.query_name:
        w = w.queryName(cfg.query_name)
    return w.start()


def fan_out_topics(t: DataFrame) -> DataFrame:
    """Every unified trade goes to ``exchange-<venue>`` and to
    ``all-exchanges``; ``value`` is its JSON record."""
    value = F.to_json(F.struct("exchange", "symbol", "price", "volume", "timestamp", "trade_id"))
    topics = F.array(F.concat(F.lit("exchange-"), F.col("exchange")), F.lit("all-exchanges"))
    return t.select(F.explode(topics).alias("topic"), "*", value.alias("value"))


def observe_trades(df: DataFrame, name: str = "trade_progress") -> DataFrame:
    """Progress counters (rows seen; last symbol, price and event
    time) attached with ``observe``; ``progress.ProgressTotals`` adds them up over
    batches and restarts."""
    ts = "timestamp" if "timestamp" in df.columns else "ts"
    return df.observe(name, F.count(F.lit(1)).alias("messages"),
                      F.max_by("symbol", ts).alias("last_symbol"),
                      F.max_by("price", ts).alias("last_price"),
                      F.max(F.col(ts).cast("timestamp")).alias("last_time"))


def _snapshots(spark, path: str):
    """(file system, {batch id: folder}) of the committed snapshots below ``path``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    if fs.exists(root):
        for status in fs.listStatus(root):
            folder = status.getPath()
            done = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
            if folder.getName().startswith("batch_id=") and fs.exists(done):
                found[int(folder.getName().split("=")[1])] = folder
    return fs, found


def upsert_latest(path: str, keep: int = 2, buckets: int = 64):
    """``foreachBatch`` function keeping the latest statistics row per
    symbol (greatest ``window_end``) in a Parquet table at ``path``: only the buckets of
    a batch's symbols are written again (``latest.upsert_by_key``)."""
    from marketlens.operators.serving import latest_stats
    from marketlens.streaming.latest import upsert_by_key

    return upsert_by_key(path, latest_stats, "symbol", buckets, keep)


def read_latest(spark, path: str):
    """The table of ``upsert_latest`` as of its newest whole batch (None before the first)."""
    from marketlens.streaming.latest import read_by_key

    return read_by_key(spark, path)
