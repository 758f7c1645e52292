"""Session helpers.

The library never relies on session settings being its own (the driver
passes its own session); these helpers only build a session for tests,
benchmarks and command-line jobs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every marketlens session wants.  AQE re-plans joins and
# coalesces/splits shuffle partitions at runtime from real sizes, which is
# what keeps broadcasts size-checked and skewed partitions split.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, app: str = "marketlens",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the marketlens defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Raises when the setting is missing: on a cluster only a folder that all
    machines see will do, and only the user knows one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a query's own tables, below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        return f"file://{tempfile.mkdtemp(prefix='marketlens-')}/{name}"
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
