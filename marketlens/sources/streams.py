"""Stream sources.

Kafka is read through Spark's own connector, which must be on the classpath
at submit time (``--packages org.apache.spark:spark-sql-kafka-0-10_2.13:<ver>``);
it is absent from the test image, so tests use the same code path over file
streams (``format="text"`` for raw messages, ``json``/``parquet`` for rows).
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketlens.functions.parse import parse_envelope, parse_unified


@dataclass
class SourceConfig:
    """Where a stream comes from.  Topic names default to the reference's
    environment variables (``KAFKA_TOPIC_RAW`` ...)."""
    format: str = "kafka"
    topic: str = field(default_factory=lambda: os.getenv("KAFKA_TOPIC_RAW", "binance-stream"))
    bootstrap_servers: str = field(
        default_factory=lambda: os.getenv("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"))
    starting_offsets: str = "latest"        # S3: "from latest"
    group_id: str | None = None             # S3: consumer-group id (offsets kept in the checkpoint)
    path: str | None = None                 # file streams
    schema: StructType | None = None        # json / parquet file streams
    max_files_per_trigger: int | None = None
    options: dict = field(default_factory=dict)


def read_raw_stream(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """Raw messages as ``(value STRING, timestamp TIMESTAMP)``.

    Kafka: ``value`` cast to string, ``timestamp`` = broker time.  Text file
    stream: one message per line, ``timestamp`` = file-source processing
    time is not deterministic, so it is NULL unless a ``json`` stream
    supplies a ``timestamp`` column.
    """
    if cfg.format == "kafka":
        r = (spark.readStream.format("kafka")
             .option("kafka.bootstrap.servers", cfg.bootstrap_servers)
             .option("subscribe", cfg.topic)
             .option("startingOffsets", cfg.starting_offsets))
        if cfg.group_id:
            r = r.option("kafka.group.id", cfg.group_id)
        for k, v in cfg.options.items():
            r = r.option(k, v)
        return r.load().select(F.col("value").cast("string").alias("value"), "timestamp")
    r = spark.readStream
    if cfg.max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", cfg.max_files_per_trigger)
    for k, v in cfg.options.items():
        r = r.option(k, v)
    if cfg.format == "text":
        return r.text(cfg.path).select("value", F.lit(None).cast("timestamp").alias("timestamp"))
    if cfg.format in ("json", "parquet"):
        return r.schema(cfg.schema).format(cfg.format).load(cfg.path)
    raise ValueError(f"unsupported stream format {cfg.format!r}")


def read_trades_stream(spark: SparkSession, cfg: SourceConfig,
                       keep_kind: bool = False) -> DataFrame:
    """The venue-envelope topic parsed into ticks ``(symbol, price, timestamp)``."""
    return parse_envelope(read_raw_stream(spark, cfg), keep_kind=keep_kind)


def read_unified_stream(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """The merged multi-venue topic, keeping the broker time as
    ``kafka_timestamp``."""
    return parse_unified(read_raw_stream(spark, cfg), broker_ts="timestamp")
