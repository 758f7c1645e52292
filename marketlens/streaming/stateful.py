"""Keyed-state processors for what row frames cannot do on a stream.

All of them are ``transformWithStateInPandas`` operators that can be chained:

* ``in_order``: the rows of each key in event-time order.  With a watermark, rows
  wait in state, in slots of time, until the watermark has passed their
  slot; a timer per slot releases them.  Without, the rows of a micro-batch are sorted.
* ``stream_indicators`` (T9): Spark rejects row frames on streams, so each
  symbol keeps its last ``HISTORY`` prices as list state; the indicators
  of new rows come from state + new rows, vectorised with numpy, in pieces of
  ``PIECE`` rows, with the same (simple-mean) definitions as the batch ``enrich``.
* ``stream_alert_latch`` (T10): the one-shot alert latch in three steps.  (1) ``in_order``
  per symbol.  (2) One state per (symbol, axis): its sorted thresholds in
  pieces, and the last value; an update reads the pieces between
  its value and the last one and emits the conditions it crosses, no others.  (3) One
  counter per alert: it fires once, at the first instant at which all its conditions hold.

They need a state store with column families (RocksDB): start them by
``sinks.write_keyed_stream`` or inside ``sinks.keyed_state``.  The processors travel by value, as
Spark also runs them in a Python process that it starts on the driver, whose path need not name this library.

State survives a restart with the query's checkpoint.  A micro-batch's rows
of one key are held together while they are sorted, so bound the batches at the source
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marketlens.operators.alerts import STATE_FIELDS, axis_keys, axis_value, threshold_conditions
from marketlens.operators.indicators import REACH
from marketlens.session import scratch_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HISTORY = REACH    # rows back: every frame of ``enrich`` is exact
PIECE = 10_000     # rows handed out at a time
SLOT_MS = 60_000   # length of the slots of rows that wait for the watermark together
INDEX_PIECE = 1024  # thresholds read together

INDICATOR_SCHEMA = ("symbol string, timestamp timestamp, event_id long, price double, "
                    "rsi double, macd_line double, signal_line double, macd_histogram double, "
                    "upper_band double, lower_band double, bb_position double")


def _windows(a: np.ndarray, n: int) -> np.ndarray:
    """Trailing windows of n values ending at each index (NaN-padded at the
    start, so early rows see the partial frame, like ``rowsBetween(-n+1, 0)``)."""
    pad = np.concatenate([np.full(n - 1, np.nan), a])
    return sliding_window_view(pad, n)


def _mean(a: np.ndarray, n: int) -> np.ndarray:
    return np.nanmean(_windows(a, n), axis=1)


def _std(a: np.ndarray, n: int) -> np.ndarray:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.nanstd(_windows(a, n), axis=1, ddof=1)


def indicator_arrays(p: np.ndarray, period=14, fast=12, slow=26, signal=9, bb=20, k=2.0):
    """Indicators for a price series that starts at the symbol's first tick
    or carries at least ``HISTORY`` earlier prices."""
    chg = np.concatenate([[np.nan], np.diff(p)])
    gain = np.where(chg > 0, chg, 0.0)
    loss = np.where(chg < 0, -chg, 0.0)
    ag = _mean(gain, period + 1)
    al = _mean(loss, period + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rs = np.where(al != 0, ag / np.where(al != 0, al, 1.0), np.nan)
        rsi = 100 - 100 / (1 + rs)
    macd = _mean(p, fast + 1) - _mean(p, slow + 1)
    sig = _mean(macd, signal + 1)
    sma = _mean(p, bb + 1)
    sd = _std(p, bb + 1)
    up, lo = sma + sd * k, sma - sd * k
    width = up - lo
    with np.errstate(divide="ignore", invalid="ignore"):
        pos = np.where(width != 0, (p - lo) / np.where(width != 0, width, 1.0), np.nan)
    return {"rsi": rsi, "macd_line": macd, "signal_line": sig, "macd_histogram": macd - sig,
            "upper_band": up, "lower_band": lo, "bb_position": pos}


def _joined(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """One key's rows of a micro-batch, sorted (missing values first, as Spark sorts them)."""
    frame = pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable", na_position="first")
    # strings of several batches are in chunks, which Arrow doesn't take back as one column
    return frame.assign(**{c: frame[c].astype(object) for c in frame if isinstance(frame[c].dtype, pd.StringDtype)})


def _pieces(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for lo in range(0, len(frame), PIECE):
        yield frame.iloc[lo:lo + PIECE]


# ------------------------------------------------------------------ order

class _Sorted(StatefulProcessor):
    """Rows of each micro-batch in order; ``first`` marks a key's very first one."""

    def __init__(self, by: list[str], columns: list[str]):
        self.by, self.columns = by, columns

    def init(self, handle):
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        frame = _joined(rows, self.by)[self.columns]
        frame["first"] = [not self.seen.exists()] + [False] * (len(frame) - 1)
        self.seen.update((True,))
        yield from _pieces(frame)

    def close(self):
        pass


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class _Released(StatefulProcessor):
    """Rows in order once the watermark has passed their slot; late rows go before.

    A slot's rows are Arrow streams, one for each time rows came for it;
    ``released`` is the end of the slot, which no watermark had passed before."""

    def __init__(self, by: list[str], columns: list[str], zone: str):
        self.by, self.columns, self.zone = by, columns, zone

    def init(self, handle):
        self.handle = handle
        self.seen = handle.getValueState("seen", "seen boolean")
        self.slots = handle.getMapState("slots", "slot long", "parts array<binary>")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for slot, own in frame.groupby("slot"):
                place = (int(slot),)
                waiting = list(self.slots.getValue(place)[0]) if self.slots.containsKey(place) else []
                if not waiting:
                    self.handle.registerTimer(place[0])
                self.slots.updateValue(place, ([*waiting, _packed(own[self.columns])],))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        place = (expiredTimerInfo.getExpiryTimeInMs(),)
        frame = _joined((pa.ipc.open_stream(x).read_pandas() for x in self.slots.getValue(place)[0]), self.by)
        self.slots.removeKey(place)
        frame["first"] = [not self.seen.exists()] + [False] * (len(frame) - 1)
        frame["released"] = pd.Timestamp(place[0], unit="ms", tz="UTC").tz_convert(self.zone).tz_localize(None)
        self.seen.update((True,))
        yield from _pieces(frame)

    def close(self):
        pass


def in_order(rows: DataFrame, key: str, time: str, order: list[str], watermark: str | None = None, slot_ms: int = SLOT_MS) -> DataFrame:
    """The rows of a stream with ``first`` (a key's very first row), per key in order.

    With ``watermark`` a key's rows come in ``order`` whatever the order of
    arrival within the delay (later rows are dropped by Spark), and ``released``
    is their new event time; without, in order within each micro-batch.  ``slot_ms``: rows
    are released so much later at most; longer slots cost fewer state entries."""
    columns = rows.columns
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    if watermark is None:
        return rows.groupBy(key).transformWithStateInPandas(_Sorted(order, columns), f"{names}, first boolean", "append", "none")
    zone = rows.sparkSession.conf.get("spark.sql.session.timeZone")
    slot = (F.floor(F.unix_millis(time) / slot_ms) + 1) * slot_ms
    waiting = rows.withWatermark(time, watermark).where(F.col(time).isNotNull()).withColumn("slot", slot.cast("long"))
    return waiting.groupBy(key).transformWithStateInPandas(
        _Released(order, columns, zone), f"{names}, first boolean, released timestamp", "append", "eventtime", eventTimeColumnName="released")


# ------------------------------------------------------------------ T9

class _Indicators(StatefulProcessor):
    """The last ``HISTORY`` prices of a symbol as list state."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle):
        self.prices = handle.getListState("prices", "price double", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        before = np.array([p for (p,) in self.prices.get()], float) if self.prices.exists() else np.zeros(0)
        for own in _pieces(_joined(rows, ["timestamp", "event_id"])):
            prices = np.concatenate([before, own["price"].to_numpy(float)])
            values = {name: x[len(before):] for name, x in indicator_arrays(prices).items()}
            yield own[["symbol", "timestamp", "event_id", "price"]].assign(**values)
            before = prices[-HISTORY:]
        self.prices.put([(float(p),) for p in before])

    def close(self):
        pass


def stream_indicators(ticks: DataFrame, watermark: str | None = None, idle_ms: int | None = None, slot_ms: int = SLOT_MS) -> DataFrame:
    """RSI / MACD / Bollinger per symbol on a stream of ticks
    ``(symbol, timestamp, price[, event_id])``; append output, one row per tick.

    Without ``watermark`` rows are processed per micro-batch in arrival order
    (sorted inside the batch).  With ``watermark`` (e.g. ``"10 minutes"``)
    they are first put ``in_order``, so the result equals the batch
    ``enrich`` even when rows arrive out of order within the delay; rows
    behind the watermark are dropped by Spark.  ``idle_ms``: forget a symbol that
    has had no tick for that long (its frames then start anew); never by default.
    """
    t = ticks if "event_id" in ticks.columns else ticks.withColumn("event_id", F.lit(None).cast("long"))
    t = t.select("symbol", "timestamp", "event_id", "price").filter(F.col("price").isNotNull())
    if watermark is not None:
        t = in_order(t, "symbol", "timestamp", ["timestamp", "event_id"], watermark, slot_ms)
    return t.groupBy("symbol").transformWithStateInPandas(
        _Indicators(idle_ms), INDICATOR_SCHEMA, "append", "none" if idle_ms is None else "processingtime")


# ------------------------------------------------------------------ T10

class _Crossings(StatefulProcessor):
    """Sorted thresholds of one (symbol, axis), and the last value."""

    def init(self, handle):
        self.last = handle.getValueState("last", "u double")
        self.bounds = handle.getValueState("bounds", "ys array<double>")
        self.index = handle.getMapState("index", "piece int", "ys array<double>, ids array<string>, ns array<int>")

    def handleInitialState(self, key, initialState, timerValues):
        own = initialState.sort_values("y", kind="stable")
        bounds = []
        for k, lo in enumerate(range(0, len(own), INDEX_PIECE)):
            piece = own.iloc[lo:lo + INDEX_PIECE]
            bounds.append(float(piece["y"].iloc[0]))
            self.index.updateValue((k,), (piece["y"].tolist(), piece["id"].tolist(), [int(n) for n in piece["n"]]))
        self.bounds.update((bounds,))

    def handleInputRows(self, key, rows, timerValues):
        if not self.bounds.exists():
            return
        own = _joined(rows, ["ts", "event_id"])
        side = "right" if key[1].endswith(">=") else "left"
        u = own["u"].to_numpy(float)
        u = np.where(np.isnan(u), -np.inf, u)  # an unknown value passes nothing
        before = self.last.get()[0] if self.last.exists() else -np.inf
        self.last.update((float(u[-1]),))
        was = np.concatenate([[before], u[:-1]])
        moved = np.flatnonzero(u != was)
        if not len(moved):
            return
        lowest, highest = min(u.min(), before), max(u.max(), before)
        bounds = np.array(self.bounds.get()[0], float)
        # the pieces that hold a threshold between the lowest and the highest value
        pieces = range(max(0, int(np.searchsorted(bounds, lowest)) - 1), int(np.searchsorted(bounds, highest, side="right")))
        if not len(pieces):
            return
        read = [self.index.getValue((k,)) for k in pieces]
        ys, ids, ns = (np.concatenate([np.array(x[c], kind) for x in read]) for c, kind in enumerate((float, object, np.int32)))
        level, level_was = np.searchsorted(ys, u[moved], side), np.searchsorted(ys, was[moved], side)
        count = np.abs(level - level_was)
        for lo in range(0, len(moved), PIECE):  # only crossed thresholds are written
            n = count[lo:lo + PIECE]
            at = np.repeat(np.arange(lo, lo + len(n)), n)
            if len(at):
                place = np.minimum(level, level_was)[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                update = own.iloc[moved[at]]
                yield pd.DataFrame({"id": ids[place], "n": ns[place], "delta": np.where(level[at] > level_was[at], 1, -1).astype(np.int32),
                                    **{c: update[c].to_numpy() for c in ("ts", "event_id", "released")}})

    def close(self):
        pass


class _Counter(StatefulProcessor):
    """How many conditions of one alert hold, and whether it has fired."""

    def init(self, handle):
        self.state = handle.getValueState("held", "held int, fired boolean")

    def handleInputRows(self, key, rows, timerValues):
        held, fired = self.state.get() if self.state.exists() else (0, False)
        if fired:
            return
        frame = pd.concat(list(rows), ignore_index=True)
        # all conditions that change at one instant change together
        step = frame.groupby(["ts", "event_id"], dropna=False, sort=True)["delta"].sum()
        step = step.sort_index(na_position="first")
        total = held + step.cumsum().to_numpy()
        hit = np.flatnonzero(total == int(frame["n"].iloc[0]))
        self.state.update((int(total[-1]), len(hit) > 0))
        if len(hit):
            ts, event_id = step.index[hit[0]]
            yield pd.DataFrame({"id": [key[0]], "trigger_ts": [ts], "trigger_event_id": [event_id]})

    def close(self):
        pass


LATCH_SCHEMA = "id string, trigger_ts timestamp, trigger_event_id long"
ANY = "*"  # stands for all symbols: its one axis has passed 0 once any update has come


def stream_alert_latch(timeline: DataFrame, alerts: DataFrame, zero_default: bool = False,
                       watermark: str | None = None, slot_ms: int = SLOT_MS) -> DataFrame:
    """First trigger per alert on a stream of symbol-state updates
    ``(symbol, ts, event_id, STATE_FIELDS...)``; equals the batch ``first_trigger``.

    ``alerts`` is a registry that does not change while the stream lives: its
    thresholds are written to a table below ``spark.checkpoint.dir`` here, and
    become the initial state of a new stream.  Alerts without conditions fire
    at the first instant.  Without ``watermark`` updates are applied per
    micro-batch in arrival order; with it in event-time order, which equals the
    batch under out-of-order arrival within the delay."""
    active = alerts.filter(~F.coalesce(F.col("triggered"), F.lit(False)))
    conditions = threshold_conditions(active)
    always = active.where("size(conditions) <= 0").select(F.lit(ANY).alias("symbol"), F.lit("any>").alias("fkey"), F.lit(0.0).alias("y"), "id", F.lit(1).alias("n"))
    # fixed from here on, and read in each micro-batch: a table of its own
    folder = scratch_dir(timeline.sparkSession, "thresholds")
    conditions.select("symbol", "fkey", "y", "id", "n").unionByName(always).write.parquet(folder)
    thresholds = timeline.sparkSession.read.parquet(folder)
    rows = in_order(timeline.select("symbol", "ts", "event_id", *STATE_FIELDS), "symbol", "ts", ["ts", "event_id"], watermark, slot_ms)
    if watermark is None:
        rows = rows.withColumn("released", F.lit(None).cast("timestamp"))
    # only the axes that a symbol's alerts test; a symbol's first row also counts for all symbols
    used = thresholds.groupBy("symbol").agg(F.collect_set("fkey").alias("used"))
    state = {f: (F.coalesce(F.col(f), F.lit(0.0)) if zero_default else F.col(f)) for f in STATE_FIELDS}
    step = lambda test, symbol, key, u: F.when(test, F.struct(symbol.alias("symbol"), F.lit(key).alias("fkey"), u.alias("u")))
    steps = [step(F.array_contains("used", k), F.col("symbol"), k, axis_value(k, state)) for k in axis_keys()]
    steps.append(step(F.col("first"), F.lit(ANY), "any>", F.lit(1.0)))
    long = (rows.join(used, "symbol", "left").select("ts", "event_id", "released", F.explode(F.array_compact(F.array(*steps))).alias("a"))
            .select("a.*", "ts", "event_id", "released"))
    crossed = long.groupBy("symbol", "fkey").transformWithStateInPandas(
        _Crossings(), "id string, n int, delta int, ts timestamp, event_id long, released timestamp", "append",
        "none" if watermark is None else "eventtime", initialState=thresholds.groupBy("symbol", "fkey"),
        eventTimeColumnName="" if watermark is None else "released")
    return crossed.groupBy("id").transformWithStateInPandas(_Counter(), LATCH_SCHEMA, "append", "none")
