"""Latest row per key from an update stream (T11), in keyed buckets.

The table is a folder of Parquet parts: each micro-batch writes only the
buckets that hold one of its keys, each as a new part, and then one manifest that
says which part each bucket is read from.  The manifest is written under another name
and renamed, so a reader sees a batch whole or not at all; a batch that fails in
between, or runs again, leaves the state before it.  Manifests beyond the last
``keep`` and parts that no kept manifest names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class _Folder:
    """File operations on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        place = self.at(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def read(self, name: str) -> str:
        with_lines = self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()
        return with_lines[0]

    def write(self, name: str, text: str) -> None:
        """The file appears with all of its text, or not at all."""
        target, draft = self.at(f"{self.path}/{name}"), self.at(f"{self.path}/{name.rpartition('/')[0]}/.{name.rpartition('/')[2]}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(target, False)  # there only if this batch has run before
        if not self.fs.rename(draft, target):
            raise OSError(f"could not rename {draft}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(f"{self.path}/{name}"), True)


def _manifest(folder: _Folder, before: int | None = None) -> dict[str, int] | None:
    """Bucket -> the batch whose part it is read from, of the newest manifest."""
    ids = [int(n.removesuffix(".json")) for n in folder.names("manifests") if n.endswith(".json") and not n.startswith(".")]
    ids = [i for i in ids if before is None or i < before]
    return json.loads(folder.read(f"manifests/{max(ids):020d}.json")) if ids else None


def _rows(folder: _Folder, parts: dict[str, int], schema) -> DataFrame:
    return folder.spark.read.schema(schema).parquet(*[f"{folder.path}/parts/batch={batch}/bucket={b}" for b, batch in parts.items()])


def upsert_by_key(path: str, newest: Callable[[DataFrame], DataFrame], key: str = "symbol", buckets: int = BUCKETS, keep: int = 2):
    """A ``foreachBatch`` function that keeps ``newest(rows)``, one row per ``key``, at ``path``.

    ``newest`` reduces the kept rows of some keys and new ones to one a key."""
    def run(batch: DataFrame, batch_id: int) -> None:
        folder = _Folder(batch.sparkSession, path)
        known = _manifest(folder, before=batch_id) or {}
        bucket = F.pmod(F.hash(key), F.lit(buckets))
        batch = batch.persist()  # read twice: its buckets, its rows
        try:
            touched = {str(r[0]) for r in batch.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets``
            if not touched and known:
                return
            old = {b: known[b] for b in touched if b in known}
            rows = batch if not old else batch.unionByName(_rows(folder, old, batch.schema))
            newest(rows).withColumn("bucket", bucket).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder.path}/parts/batch={batch_id}")
        finally:
            batch.unpersist()
        folder.write(f"manifests/{batch_id:020d}.json", json.dumps(known | dict.fromkeys(touched, batch_id)))
        _tidy(folder, keep)
    return run


def _tidy(folder: _Folder, keep: int) -> None:
    names = sorted(n for n in folder.names("manifests") if n.endswith(".json") and not n.startswith("."))
    for n in names[:-keep]:
        folder.remove(f"manifests/{n}")
    used = {(b, batch) for n in names[-keep:] for b, batch in json.loads(folder.read(f"manifests/{n}")).items()}
    newest = int(names[-1].removesuffix(".json"))
    for part in folder.names("parts"):
        batch = int(part.partition("=")[2])
        if batch >= newest:
            continue  # a batch that is being written has no manifest yet
        own = [x.partition("=")[2] for x in folder.names(f"parts/{part}") if x.startswith("bucket=")]
        live = [b for b in own if (b, batch) in used]
        if not live:
            folder.remove(f"parts/{part}")
        for b in set(own) - set(live) if live else ():
            folder.remove(f"parts/{part}/bucket={b}")


def read_by_key(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of its newest manifest; None before the first one."""
    folder = _Folder(spark, path)
    parts = _manifest(folder)
    if not parts:
        return None
    paths = [f"{folder.path}/parts/batch={batch}/bucket={b}" for b, batch in sorted(parts.items())]
    return spark.read.parquet(*paths)
