"""Running totals of a stream (S11, T7): messages seen, late rows dropped.

``ProgressTotals`` is a ``StreamingQueryListener``: each micro-batch adds its
``observe`` counters (``sinks.observe_trades``) and the rows that its state
operators dropped behind the watermark.  The totals are written after each batch
to a folder that belongs beside the query's checkpoint, so they go on after a restart
and do not depend on the progress records that Spark keeps; a batch that
is run again replaces its own figures.

A state operator behind an aggregation sees one row for each group and task
(map-side combining), and counts late ones as such.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from marketlens.streaming.sinks import _snapshots

SCHEMA = "batch_id long, messages long, late_rows long, reports long, last_symbol string, last_price double, last_time timestamp"
START = {"batch_id": -1, "messages": 0, "late_rows": 0, "reports": 0, "last_symbol": None, "last_price": None, "last_time": None}


class ProgressTotals(StreamingQueryListener):
    """Totals of the one query that it is used ``with``.

    ``folder``: where they are kept; ``metric``: the name given to ``observe``;
    ``every``: ``report`` gets the totals each time so many more messages have passed
    (checked batch by batch)."""

    def __init__(self, spark: SparkSession, folder: str, metric: str = "trade_progress",
                 every: int = 100, report: Callable[[dict], None] | None = None, keep: int = 2):
        self.spark, self.folder, self.metric = spark, folder.rstrip("/"), metric
        self.every, self.report, self.keep = every, report, keep
        self.lock, self.known, self.waiting, self.ended = threading.RLock(), {}, {}, {}
        self.run_id = None
        self.error: Exception | None = None

    # the listener's bus calls these, whichever query it is about

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = p.observedMetrics.get(self.metric)
        batch = {"batch_id": p.batchId, "messages": own["messages"] if own else 0,
                 "late_rows": sum(op.numRowsDroppedByWatermark for op in p.stateOperators),
                 "last_symbol": own["last_symbol"] if own else None, "last_price": own["last_price"] if own else None,
                 "last_time": own["last_time"] if own else None}
        with self.lock:
            self.waiting.setdefault(str(p.runId), []).append(batch)
            self._add()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.setdefault(str(event.runId), threading.Event()).set()

    # ---

    def follow(self, query: StreamingQuery) -> StreamingQuery:
        """From now on this run's batches count (those it has run already, too)."""
        with self.lock:
            self.run_id = str(query.runId)
            self._add()
        return query

    def finish(self, query: StreamingQuery, timeout: float = 600) -> dict:
        """Waits for the query's end and its last event; the totals then."""
        query.awaitTermination()
        with self.lock:
            end = self.ended.setdefault(str(query.runId), threading.Event())
        # events come in order: after this one there is no more progress
        if not end.wait(timeout):
            raise TimeoutError("the query's last event has not come")
        if self.error:
            raise self.error
        return self.totals()

    def __enter__(self):
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_):
        self.spark.streams.removeListener(self)

    def _before(self, batch_id: int) -> dict:
        """The totals before a batch."""
        if batch_id - 1 in self.known:
            return self.known[batch_id - 1]
        _, found = _snapshots(self.spark, self.folder)
        earlier = [i for i in found if i < batch_id]
        if not earlier:
            return START
        return self.spark.read.schema(SCHEMA).parquet(found[max(earlier)].toString()).first().asDict()

    def _add(self) -> None:
        if self.run_id is None:
            return
        for batch in self.waiting.pop(self.run_id, []):
            try:
                before = self._before(batch["batch_id"])
                now = {k: before[k] + batch[k] for k in ("messages", "late_rows")} | {"batch_id": batch["batch_id"]}
                newer = batch["last_time"] is not None and (before["last_time"] is None or batch["last_time"] >= before["last_time"])
                now |= {k: (batch if newer else before)[k] for k in ("last_symbol", "last_price", "last_time")}
                now["reports"] = now["messages"] // self.every
                row = self.spark.createDataFrame([tuple(now[c] for c in START)], SCHEMA)
                row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch_id={batch['batch_id']}")
                self.known = {batch["batch_id"]: now}
                fs, found = _snapshots(self.spark, self.folder)
                for old in sorted(found)[:-self.keep]:
                    fs.delete(found[old], True)
                if self.report and now["reports"] > before["reports"]:
                    self.report(now)
            except Exception as error:  # the bus would only log it
                self.error = self.error or error

    def table(self) -> DataFrame:
        """The totals as a one-row table."""
        _, found = _snapshots(self.spark, self.folder)
        if not found:
            return self.spark.createDataFrame([tuple(START.values())], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(found[max(found)].toString())

    def totals(self) -> dict:
        return self.table().first().asDict()
