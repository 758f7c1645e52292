"""User-defined multi-condition alerts.

An alert is ``(id, name, conditions ARRAY<STRUCT<symbol,type,threshold>>,
email, status, triggered)``.  Each condition may name a different symbol and
an alert fires when *all* its conditions hold at the same instant (an alert
without conditions fires at once, like Python's ``all([])``).

* ``evaluate_alerts`` (L3) checks a *snapshot* of symbol state: conditions
  are exploded and left-joined to the state on symbol (one state row per
  symbol, so AQE broadcasts it when small; a hot symbol only makes the
  condition side skewed, which AQE's skew join splits).
* ``first_trigger`` (L4) replays a state *timeline* and returns the first
  instant at which each alert holds (the one-shot latch).  It never pairs
  conditions with updates: the peaks of each (symbol, axis) per time bucket
  give each condition's first passage, by the running maximum; only in
  buckets where all conditions of an alert have a peak above their thresholds are the
  instants looked at, all alerts of a bucket on one pass over its rows, in order and in pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.frames import DEFAULT_BLOCK_ROWS, block_window, drop_blocks, with_row_blocks
from marketlens.operators.indicators import REACH, enrich

# Condition types of the evaluator -> (state field, comparison).
THRESHOLD_TYPES = {
    "price_above": ("price", ">"), "price_below": ("price", "<"),
    "volatility_above": ("volatility", ">"), "volume_above": ("volume", ">"),
    "rsi_above": ("rsi", ">"), "rsi_below": ("rsi", "<"),
}
VOLATILITY_BELOW = ("volatility", "<")      # offered by the form only (Q5)
FIXED_TYPES = ["macd_positive", "macd_negative", "bollinger_upper", "bollinger_lower"]
STATE_FIELDS = ["price", "volume", "volatility", "rsi", "macd", "bollinger_upper",
                "bollinger_lower"]

SEQ_RANGE = 10_000      # submissions ranked together

# Mail text of the trigger notice.
MAIL_SUBJECT_PREFIX = "🚨 Alerte Crypto: "


# ---------------------------------------------------------------- L6 registry

def valid_conditions(conditions: Column) -> Column:
    """UI filter: keep conditions with a threshold, or of a ``macd_*`` /
    ``bollinger_*`` type (which need none)."""
    return F.filter(conditions, lambda c: (c["threshold"] != "") |
                    c["type"].contains("macd_") | c["type"].contains("bollinger_"))


def create_alerts(registry: DataFrame, new: DataFrame) -> DataFrame:
    """L6 create: validate ``new`` (name, email and >= 1 valid condition) and
    append it.  ``new`` carries ``seq`` (0-based submission order); ids are
    ``name_<count>`` where count = stored alerts at creation time, so rejected
    submissions take no number."""
    base = registry.agg(F.count("*")).scalar()
    ok = new.withColumn("conditions", valid_conditions(F.col("conditions"))) \
            .filter((F.coalesce(F.col("name"), F.lit("")) != "") &
                    (F.coalesce(F.col("email"), F.lit("")) != "") &
                    (F.size("conditions") > 0))
    # rank among the valid submissions: inside ranges of ``seq``, plus the
    # sizes of the ranges before (a short table)
    ok = ok.withColumn("_part", F.floor(F.col("seq") / SEQ_RANGE))
    ok = ok.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("seq")) - 1)
    before = ok.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = ok.join(before, "_part").select(
        F.concat(F.col("name"), F.lit("_"), (base + F.col("_before") + F.col("_rank")).cast("string"))
         .alias("id"), "name", "conditions", "email",
        F.lit("active").alias("status"), F.lit(False).alias("triggered"))
    return registry.unionByName(rows)


def delete_alerts(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """L6 delete: drop alerts whose id is in ``ids`` (left-anti join)."""
    return registry.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_anti")


# ---------------------------------------------------------------- L1 predicates

def _threshold(c: Column) -> Column:
    """``float(t) if t else 0``; unparsable -> NULL (condition false)."""
    return F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(c.try_cast("double"))


def condition_met(ctype: Column, threshold: Column, state: dict[str, Column],
                  volatility_below: bool = False) -> Column:
    """L1 (+L2): the evaluator's CASE over condition types; unknown types,
    unparsable thresholds and NULL operands give false."""
    x = _threshold(threshold)
    s = state
    cases = [
        ("price_above", s["price"] > x), ("price_below", s["price"] < x),
        ("volatility_above", s["volatility"] > x), ("volume_above", s["volume"] > x),
        ("rsi_above", s["rsi"] > x), ("rsi_below", s["rsi"] < x),
        ("macd_positive", s["macd"] > 0), ("macd_negative", s["macd"] < 0),
        ("bollinger_upper", s["price"] >= s["bollinger_upper"] * 0.99),
        ("bollinger_lower", s["price"] <= s["bollinger_lower"] * 1.01),
    ]
    if volatility_below:
        cases.append(("volatility_below", s["volatility"] < x))
    out = None
    for name, pred in cases:
        out = F.when(ctype == name, pred) if out is None else out.when(ctype == name, pred)
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def _state_cols(prefix: str, zero_default: bool) -> dict[str, Column]:
    cols = {f: F.col(prefix + f) for f in STATE_FIELDS}
    if zero_default:
        cols = {f: F.coalesce(c, F.lit(0.0)) for f, c in cols.items()}
    return cols


def explode_conditions(alerts: DataFrame) -> DataFrame:
    """One row per (alert, condition); alerts without conditions keep one row
    with NULL condition (``posexplode_outer``)."""
    return alerts.select("id", "name", "email",
                         F.size("conditions").alias("n_conditions"),
                         F.posexplode_outer("conditions").alias("cond_idx", "cond"))


# ---------------------------------------------------------------- L3 snapshot

def evaluate_alerts(alerts: DataFrame, state: DataFrame, zero_default: bool = False,
                    volatility_below: bool = False) -> DataFrame:
    """L3: which active (not yet triggered) alerts hold on a state snapshot.

    ``state``: one row per symbol with ``STATE_FIELDS``.  Unknown symbol ->
    false.  ``zero_default=True`` reads missing (NULL) state values as 0, the
    deployed API's defaults (Q6).
    """
    active = alerts.filter(~F.coalesce(F.col("triggered"), F.lit(False)))
    c = explode_conditions(active)
    st = state.select(F.col("symbol").alias("s_symbol"),
                      *[F.col(f).alias("s_" + f) for f in STATE_FIELDS])
    j = c.join(st, c["cond.symbol"] == st["s_symbol"], "left")
    met = F.when(F.col("s_symbol").isNull(), F.lit(False)).otherwise(
        condition_met(F.col("cond.type"), F.col("cond.threshold"),
                      _state_cols("s_", zero_default), volatility_below))
    g = j.groupBy("id", "name", "email", "n_conditions").agg(
        F.bool_and(F.when(F.col("cond").isNull(), F.lit(True)).otherwise(met)).alias("all_met"))
    return g.select("id", "name", "email", "n_conditions",
                    ((F.col("n_conditions") <= 0) | F.col("all_met")).alias("fired"))


# ---------------------------------------------------------------- L4 latch

# Every condition type as ``u OP y`` on one signed axis: '>' strict, '>='
# non-strict; '<' types negate field and threshold (exact in IEEE).  The
# band tests use ``price - upper*0.99 >= 0``, which has the same truth as
# ``price >= upper*0.99`` (a difference of doubles is 0 only for equal
# operands), so every type is a threshold crossing.
_AXES = {
    "price_above": ("price", ">", None), "price_below": ("price", "<", None),
    "volatility_above": ("volatility", ">", None), "volume_above": ("volume", ">", None),
    "rsi_above": ("rsi", ">", None), "rsi_below": ("rsi", "<", None),
    "macd_positive": ("macd", ">", 0.0), "macd_negative": ("macd", "<", 0.0),
    "bollinger_upper": ("band_up", ">=", 0.0), "bollinger_lower": ("band_low", ">=", 0.0),
}


#: The state columns that the axes are made of, by name.
AXIS_BASES = {
    "price": lambda s: s["price"], "volatility": lambda s: s["volatility"], "volume": lambda s: s["volume"],
    "rsi": lambda s: s["rsi"], "macd": lambda s: s["macd"],
    "band_up": lambda s: s["price"] - s["bollinger_upper"] * 0.99,
    "band_low": lambda s: s["bollinger_lower"] * 1.01 - s["price"],
}


def _axes(volatility_below: bool) -> dict:
    return _AXES | ({"volatility_below": (*VOLATILITY_BELOW, None)} if volatility_below else {})


def threshold_conditions(alerts: DataFrame, volatility_below: bool = False) -> DataFrame:
    """``(id, n, cond_idx, symbol, fkey, y)``: each condition as the test ``u > y`` (or
    ``>=``) on the axis ``fkey`` of its symbol, the name of a base column and
    the comparison.  Conditions that can never hold (unknown type, a threshold that
    is no number) are left out."""
    axes = _axes(volatility_below)
    fkey_of = F.create_map(*[x for k, (base, op, _) in axes.items() for x in (F.lit(k), F.lit(base + op))])
    fixed_y = F.create_map(*[x for k, (_, _, y) in axes.items() if y is not None for x in (F.lit(k), F.lit(y))])
    c = explode_conditions(alerts).select(
        "id", F.col("n_conditions").alias("n"), "cond_idx", F.col("cond.symbol").alias("symbol"),
        F.col("cond.type").alias("type"), F.col("cond.threshold").alias("thr"), fkey_of[F.col("cond.type")].alias("fkey"))
    x = _threshold(F.col("thr"))
    y = F.coalesce(fixed_y[F.col("type")], F.when(F.col("fkey").endswith("<"), -x).otherwise(x))
    return (c.filter(F.col("fkey").isNotNull() & F.col("symbol").isNotNull()).withColumn("y", y)
             .filter(F.col("y").isNotNull() & ~F.isnan("y")).select("id", "n", "cond_idx", "symbol", "fkey", "y"))


def axis_keys(volatility_below: bool = False) -> list[str]:
    return list(dict.fromkeys(base + op for base, op, _ in _axes(volatility_below).values()))


def axis_value(fkey: str, state: dict[str, Column]) -> Column:
    """An axis of a state (field -> column)."""
    value = AXIS_BASES[fkey.rstrip("<>=")](state)
    return -value if fkey.endswith("<") else value


def _previous() -> list[Column]:
    """The state before each row of a blocked timeline, and whether there is one."""
    bw = block_window(["symbol"])
    return [*[F.lag(f).over(bw).alias("prev_" + f) for f in STATE_FIELDS],
            F.coalesce(F.lag(F.lit(True)).over(bw), F.lit(False)).alias("prev_known")]


def _first_passage(conds: DataFrame, peaks: DataFrame) -> DataFrame:
    """``conds`` with ``first``: the first bucket whose peak passes the threshold.

    A series' running maximum grows with time, so its *records* (buckets whose peak
    is above all before) are in one order by time and by value, and the first
    passage of a threshold is the least record above it.  Records and
    thresholds are matched in value order, by ranges of the value: inside each
    range by one running pass, from the next range with a record otherwise."""
    before = F.max("peak").over(Window.partitionBy("symbol", "fkey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    records = (peaks.withColumn("before", before).filter(F.col("before").isNull() | (F.col("peak") > F.col("before")))
               .select("symbol", "fkey", F.col("peak").alias("y"), "bucket"))
    both = conds.withColumn("bucket", F.lit(None).cast(peaks.schema["bucket"].dataType)).unionByName(records, allowMissingColumns=True)
    # grows with the value: ranges of a few thousandths of it
    both = both.withColumn("_range", F.floor(F.signum("y") * F.log1p(F.abs("y")) * 256))
    # a record that equals a threshold passes it only where the test is '>='
    tie = F.when(F.col("bucket").isNull() == F.col("fkey").endswith(">="), 1).otherwise(0)
    inside = Window.partitionBy("symbol", "fkey", "_range").orderBy(F.desc("y"), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy("symbol", "fkey").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = (both.groupBy("symbol", "fkey", "_range").agg(F.min("bucket").alias("_least"))
              .select("symbol", "fkey", "_range", F.last("_least", ignorenulls=True).over(above).alias("_next")))
    own = both.withColumn("_own", F.last("bucket", ignorenulls=True).over(inside)).filter(F.col("id").isNotNull())
    return own.join(ranges, ["symbol", "fkey", "_range"]).select(*conds.columns, F.coalesce("_own", "_next").alias("first"))


class _OpenAlerts:
    """The alerts of one bucket that have not fired, and the state of their symbols
    before the rows to come."""

    def __init__(self):
        self.by_symbols, self.state = {}, {}

    def add(self, rows) -> None:
        for a, tests in zip(rows["id"].to_pylist(), rows["tests"].to_pylist(), strict=True):
            own = tuple(sorted({t["symbol"] for t in tests}))
            self.by_symbols.setdefault(own, []).append((a, tests))

    def keep(self, rows) -> None:
        """The last row of each symbol is its state from here on (only alerts on several
        symbols look at a state from before a symbol's updates)."""
        several = {x for own in self.by_symbols if len(own) > 1 for x in own}
        if not several:
            return
        names, symbols = _codes(rows)
        last = _last_rows(symbols)
        values = {b: rows[b].to_numpy()[last] for b in AXIS_BASES}
        for i, symbol in enumerate(names[symbols[last]]):
            if symbol in several:
                self.state[symbol] = {b: values[b][i] for b in AXIS_BASES}

    def check(self, rows, at) -> list[tuple[str, int]]:
        """Alerts that hold at one of the instants ``at`` (a number for each row, in order),
        with the first such row; they are open no longer."""
        import numpy as np
        names, symbols = _codes(rows)
        order = np.argsort(symbols, kind="stable")
        own_rows = dict(zip(names, np.split(order, np.searchsorted(symbols[order], np.arange(1, len(names)))), strict=True))
        found = []
        for own in list(self.by_symbols):
            updated = [own_rows[x] for x in own if x in own_rows]
            if not updated:
                continue
            instants = np.unique(at[np.concatenate(updated)])
            values = {}

            def series(symbol, base):
                if (symbol, base) not in values:
                    before = self.state.get(symbol, {}).get(base, np.nan)  # an unknown state passes nothing
                    if symbol in own_rows:
                        mine = own_rows[symbol]
                        place = np.searchsorted(at[mine], instants, side="right") - 1
                        values[symbol, base] = np.where(place >= 0, rows[base].to_numpy()[mine][np.maximum(place, 0)], before)
                    else:
                        values[symbol, base] = np.full(len(instants), before)
                return values[symbol, base]

            still = []
            for a, tests in self.by_symbols[own]:
                held = np.ones(len(instants), bool)
                for t in tests:
                    u = t["sign"] * series(t["symbol"], t["base"])
                    held &= (u > t["y"]) if t["strict"] else (u >= t["y"])
                if held.any():
                    found.append((a, int(np.searchsorted(at, instants[held.argmax()]))))
                else:
                    still.append((a, tests))
            if still:
                self.by_symbols[own] = still
            else:
                del self.by_symbols[own]
        return found


def _codes(rows):
    """The symbols of some rows as an array of names and numbers into it."""
    import numpy as np
    coded = rows["symbol"].combine_chunks().dictionary_encode()
    return np.array(coded.dictionary.to_pylist(), object), coded.indices.to_numpy()


def _last_rows(symbols):
    """The place of each symbol's last row, in order."""
    import numpy as np
    return np.sort(len(symbols) - 1 - np.unique(symbols[::-1], return_index=True)[1])


def _instants(rows, order):
    """The number of each row's instant; equal ``order`` (missing equals missing) is one instant."""
    import numpy as np
    import pyarrow.compute as pc
    new = np.zeros(len(rows), bool)
    for c in order:
        x = rows[c].combine_chunks()
        ahead, behind = x.slice(1), x.slice(0, len(x) - 1)
        other = pc.coalesce(pc.not_equal(ahead, behind), pc.xor(ahead.is_null(), behind.is_null()))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.cumsum(new)


CHECK_ROWS = 100_000   # rows of a bucket that a task looks at together


def _check_buckets(batches, order, piece):
    """The first instant of each bucket at which all conditions of an alert hold.  Per
    (bucket, slice) come its alerts, then the states that symbols begin it with, then
    its updates in order; no more than about ``piece`` of them are held."""
    import numpy as np
    import pyarrow as pa

    def hits(found, rows):
        where = pa.array([i for _, i in found], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), *(rows[c].combine_chunks().take(where) for c in order)], ["id", *order])

    def checked(alerts, waiting, whole):
        """Hits of the waiting updates, and those of an instant that may go on."""
        rows = pa.concat_tables(waiting)
        at = _instants(rows, order)
        end = len(rows) if whole else int(np.searchsorted(at, at[-1]))
        done, rest = rows.slice(0, end), rows.slice(end)
        found = alerts.check(done, at[:end]) if end else []
        if end:
            alerts.keep(done)
        if len(rest):  # of one instant: a symbol's last row is its state
            rest = rest.take(_last_rows(_codes(rest)[1]))
        return found, done, [rest] if len(rest) else []

    keys = ["bucket", "slice"]
    bucket, before, alerts, waiting, n = None, None, None, [], 0
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        own, kind = table.select(keys), table["kind"].to_numpy()
        # buckets are numbered on from batch to batch
        own = _instants(own, keys) if before is None else bucket + _instants(pa.concat_tables([before, own]), keys)[1:]
        before = table.select(keys).slice(len(table) - 1)
        cuts = np.flatnonzero((own[1:] != own[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(own)], strict=True):
            rows = table.slice(lo, hi - lo)
            if own[lo] != bucket:
                if waiting:
                    found, done, _ = checked(alerts, waiting, True)
                    if found:
                        yield hits(found, done)
                bucket, alerts, waiting, n = own[lo], _OpenAlerts(), [], 0
            if kind[lo] == 0:
                alerts.add(rows)
            elif not alerts.by_symbols:
                waiting, n = [], 0
            elif kind[lo] == 1:
                alerts.keep(rows)
            else:
                waiting.append(rows)
                n += len(rows)
                if n >= piece:
                    found, done, waiting = checked(alerts, waiting, False)
                    n = sum(map(len, waiting))
                    if found:
                        yield hits(found, done)
    if waiting:
        found, done, _ = checked(alerts, waiting, True)
        if found:
            yield hits(found, done)


PER_TASK = 50_000      # alerts that one task looks at together


def first_trigger(alerts: DataFrame, timeline: DataFrame, zero_default: bool = False,
                  volatility_below: bool = False, block_rows=DEFAULT_BLOCK_ROWS, bucket: str = "hour") -> DataFrame:
    """L4: first ``(ts, event_id)`` at which all conditions of each active
    alert hold simultaneously; later instants are ignored (one-shot).

    ``timeline``: ``symbol, ts, event_id`` + ``STATE_FIELDS`` (+ ``prev_*`` and
    ``prev_known``, the state before the update; computed here when absent) – see
    ``state_timeline``.  It is read three times, so pass a written table where it
    is dear.  The state of a symbol between its updates is its
    last update; before its first update the symbol is unknown (conditions
    false).  ``bucket``: the time unit whose rows one task looks at, a piece at a time; it changes no value.
    Returns ``id, name, email, trigger_ts, trigger_event_id``.
    """
    active = alerts.filter(~F.coalesce(F.col("triggered"), F.lit(False)))
    need = active.select("id", "name", "email", F.size("conditions").alias("n"))
    conds = threshold_conditions(active, volatility_below)
    order = ["ts", "event_id"]
    if not all(c in timeline.columns for c in ["prev_known", *("prev_" + f for f in STATE_FIELDS)]):
        b = with_row_blocks(timeline.drop("prev_known", *("prev_" + f for f in STATE_FIELDS)),
                            keys=["symbol"], order=order, halo=1, block_rows=block_rows)
        timeline = drop_blocks(b.select("*", *_previous()))
    zd = (lambda c: F.coalesce(c, F.lit(0.0))) if zero_default else (lambda c: c)
    now = {f: zd(F.col(f)) for f in STATE_FIELDS}
    # before its first update a symbol is unknown, not zero
    was = {f: F.when(F.col("prev_known"), zd(F.col("prev_" + f))) for f in STATE_FIELDS}
    time = timeline.schema["ts"].dataType
    floor = F.lit("0001-01-01 00:00:00").cast(time)     # rows without a time come first
    tl = timeline.withColumn("bucket", F.coalesce(F.date_trunc(bucket, "ts").cast(time), floor))

    # the highest value of each axis in each bucket, the one it begins with included
    keys = axis_keys(volatility_below)
    wide = tl.groupBy("symbol", "bucket").agg(*[F.max(F.greatest(axis_value(k, now), axis_value(k, was))).alias(k) for k in keys])
    peaks = (wide.select("symbol", "bucket", F.explode(F.array(*[F.struct(F.lit(k).alias("fkey"), F.col(f"`{k}`").alias("peak")) for k in keys])).alias("a"))
             .select("symbol", "bucket", "a.*").filter(F.col("peak").isNotNull()))

    # no alert holds before the last first passage of its conditions; one with a
    # single condition holds right there, others perhaps, or in a later bucket in
    # which each condition holds at some time (a symbol without an update there
    # keeps its state, which the task looks at)
    own = Window.partitionBy("id")
    test = F.struct("symbol", F.rtrim("fkey", F.lit("<>=")).alias("base"), F.when(F.col("fkey").endswith("<"), -1.0).otherwise(1.0).alias("sign"),
                    (~F.col("fkey").endswith("=")).alias("strict"), "y")
    passed = (_first_passage(conds, peaks).withColumns({"start": F.max("first").over(own), "passed": F.count("first").over(own), "tests": F.collect_list(test).over(own)})
              .filter(F.col("passed") == F.col("n")))
    holds = (F.col("peak") > F.col("y")) | (F.col("fkey").endswith("=") & (F.col("peak") == F.col("y")))
    pairs = (passed.join(peaks, ["symbol", "fkey"]).filter((F.col("bucket") == F.col("start")) | ((F.col("n") > 1) & (F.col("bucket") > F.col("start"))))
             .groupBy("id", "bucket").agg(F.bool_and(holds).alias("may"), F.first("tests").alias("c")).filter("may"))
    slices = F.greatest(need.agg(F.ceil(F.count("*") / PER_TASK).cast("int")).scalar(), F.lit(1))
    tests = pairs.select("bucket", F.pmod(F.hash("id"), slices).alias("slice"), F.lit(0).alias("kind"), "id", F.col("c").alias("tests"))

    bases = [f(now).cast("double").alias(k) for k, f in AXIS_BASES.items()]
    state = tl.filter(F.col("symbol").isNotNull()).select("symbol", "bucket", *order, *bases, F.struct(*[f(was).cast("double").alias(k) for k, f in AXIS_BASES.items()]).alias("was"))
    rows = state.drop("was").withColumn("kind", F.lit(2)).unionByName(_carried(conds, state, bucket, floor).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    # a task reads its buckets' rows in order, a piece at a time: a bucket may hold more than a task's memory
    place = ["bucket", "slice"]
    both = tests.unionByName(rows, allowMissingColumns=True).repartition(*place).sortWithinPartitions(*place, "kind", *order)
    kinds = {c: timeline.schema[c].dataType.simpleString() for c in order}
    piece = CHECK_ROWS
    hits = both.mapInArrow(lambda batches: _check_buckets(batches, order, piece), f"id string, ts {kinds['ts']}, event_id {kinds['event_id']}")
    early = hits.groupBy("id").agg(F.min(F.struct(*order)).alias("first"))
    fired = early.join(need, "id").select("id", "name", "email", F.col("first.ts").alias("trigger_ts"),
                                          F.col("first.event_id").alias("trigger_event_id"))
    # zero-condition alerts fire at the first instant of the timeline
    first_any = timeline.select(*order).agg(F.min(F.struct(*order)).alias("f"))
    zero = need.filter(F.col("n") <= 0).select(
        "id", "name", "email", first_any.select("f.ts").scalar().alias("trigger_ts"),
        first_any.select("f.event_id").scalar().alias("trigger_event_id"))
    return fired.unionByName(zero)


def _carried(conds: DataFrame, state: DataFrame, bucket: str, floor: Column) -> DataFrame:
    """The state that each symbol begins a bucket with, whether it has updates there or not, for the
    symbols of alerts that name several: such an alert can hold by another symbol's update."""
    several = conds.groupBy("id").agg(F.min("symbol").alias("a"), F.max("symbol").alias("b")).filter("a < b").select("id")
    symbols = conds.join(several, "id", "left_semi").select("symbol").distinct()
    last = (state.join(symbols, "symbol", "left_semi").groupBy("symbol", "bucket")
            .agg(F.max_by(F.struct(*AXIS_BASES), F.struct("ts", "event_id")).alias("s"), F.min_by("was", F.struct("ts", "event_id")).alias("was")))
    ends = state.agg(F.struct(F.min("ts"), F.max("ts")).alias("e"))
    lowest, highest = (F.date_trunc(bucket, ends.select(f"e.col{i}").scalar()).cast(state.schema["bucket"].dataType) for i in (1, 2))
    unit = F.expr(f"interval 1 {bucket}")
    after = F.when(F.col("bucket") == floor, lowest).otherwise(F.col("bucket") + unit)
    following = F.lead("bucket").over(Window.partitionBy("symbol").orderBy("bucket"))
    ranges = last.withColumn("following", following).withColumns({"after": after, "until": F.coalesce("following", highest + unit) - unit})
    gaps = ranges.filter("after <= until").select("symbol", "s", F.explode(F.sequence("after", "until", unit)).alias("bucket"))
    return gaps.select("symbol", "bucket", "s.*").unionByName(last.select("symbol", "bucket", "was.*"))


def running_window_stats(t: DataFrame, stats_width: str = "5 minutes",
                         chunk: str = "1 minute") -> DataFrame:
    """Running trade count (``volume``) and sample stddev (``volatility``) of
    each trade's statistics window up to and including the trade.

    Built from pieces no larger than one ``chunk`` (minute) of one symbol:
    running moments inside each (symbol, window, minute) piece, plus the
    moments of the window's earlier pieces from a small per-piece table
    (prefix sums shifted by the window's first piece mean, so constant prices
    give exactly 0), merged with Chan et al.'s pairwise formula.  Equal to a
    running ``stddev`` over the whole window up to floating-point rounding.
    """
    from marketlens.operators.frames import _surrogates
    order = ["ts", "event_id"]
    # one time-window expression per projection (Spark rejects two in one)
    s = t.withColumn("_w", F.window("ts", stats_width).start) \
         .withColumn("_c", F.window("ts", chunk).start)
    s, sk = _surrogates(s, ["symbol", "_w", "_c"])
    inner = (Window.partitionBy(*sk).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.withColumns({"_nb": F.count("price").over(inner),
                       "_mb": F.avg("price").over(inner),
                       "_m2b": F.var_pop("price").over(inner) * F.count("price").over(inner)})
    pieces = s.groupBy(*sk).agg(F.count("price").alias("cn"), F.avg("price").alias("cm"),
                                F.coalesce(F.var_pop("price") * F.count("price"),
                                           F.lit(0.0)).alias("cq"))
    win = sk[:4]                                  # symbol and window surrogates
    w_all = Window.partitionBy(*win).orderBy(sk[4], sk[5])
    before = w_all.rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_k", F.first("cm", ignorenulls=True).over(
        w_all.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    d = F.col("cm") - F.col("_k")
    pieces = pieces.select(*sk,
                           F.coalesce(F.sum("cn").over(before), F.lit(0)).alias("_na"),
                           F.sum(F.col("cn") * d).over(before).alias("_sa"),
                           F.sum(F.col("cq") + F.col("cn") * d * d).over(before).alias("_qa"),
                           "_k")
    j = s.join(pieces, sk, "inner")
    na, nb = F.col("_na").cast("double"), F.col("_nb").cast("double")
    mean_a = F.col("_k") + F.col("_sa") / na
    m2_a = F.col("_qa") - F.col("_sa") * F.col("_sa") / na
    n = na + nb
    delta = F.col("_mb") - mean_a
    m2 = (F.when(F.col("_na") == 0, F.col("_m2b"))
           .when(F.col("_nb") == 0, m2_a)
           .otherwise(m2_a + F.col("_m2b") + delta * delta * na * nb / n))
    vol = F.when(n >= 2, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))
    return j.withColumns({"volume": n, "volatility": vol}).drop(
        *sk, "_w", "_c", "_nb", "_mb", "_m2b", "_na", "_sa", "_qa", "_k")


def state_timeline(t: DataFrame, stats_width: str = "5 minutes",
                   block_rows=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Symbol state after each trade, and the state before it (``prev_*``,
    ``prev_known``).

    ``price`` and the indicators are the trade's ``enrich`` values;
    ``volume`` / ``volatility`` are the running trade count and sample stddev
    of the trade's statistics window up to that trade (what an update-mode
    statistics stream has emitted by then), built from one-minute pieces
    (``running_window_stats``); the indicators and all ``prev_*`` columns come
    from one blocked pass (``with_row_blocks``).
    """
    e = enrich(running_window_stats(t, stats_width), keys=("symbol",), block_rows=block_rows,
               extra=("volume", "volatility"), keep_blocks=True)
    e = e.select("symbol", "ts", "event_id", "price", "volume", "volatility", "rsi",
                 F.col("macd_line").alias("macd"), F.col("upper_band").alias("bollinger_upper"),
                 F.col("lower_band").alias("bollinger_lower"), "_pos", "_blk", "_halo")
    return drop_blocks(e.select("*", *_previous()))


def latest_state(t: DataFrame, stats_width: str = "5 minutes") -> DataFrame:
    """Symbol-state snapshot after the last trade of each symbol.

    Only the last ``REACH`` trades per symbol are needed for the indicators of
    the last trade: ``row_number() <= REACH`` is planned with a WindowGroupLimit below the
    shuffle, so a hot symbol ships at most that many rows per partition.
    ``volume`` / ``volatility`` are the count and stddev of the symbol's
    latest statistics window (a partial + final aggregate).
    """
    from marketlens.operators.serving import latest_stats, recent_per_symbol
    from marketlens.operators.stats import window_stats
    last = recent_per_symbol(t, REACH).drop("pos")
    e = enrich(last, block_rows=None)
    row = F.struct("price", "rsi", "macd_line", "upper_band", "lower_band")
    ind = e.groupBy("symbol").agg(F.max_by(row, F.struct("ts", "event_id")).alias("r"))
    st = latest_stats(window_stats(t, stats_width, with_trend_col=False))
    return ind.join(st.select("symbol", F.col("trade_count").cast("double").alias("volume"),
                              "volatility"), "symbol", "left").select(
        "symbol", F.col("r.price").alias("price"), "volume", "volatility",
        F.col("r.rsi").alias("rsi"), F.col("r.macd_line").alias("macd"),
        F.col("r.upper_band").alias("bollinger_upper"),
        F.col("r.lower_band").alias("bollinger_lower"))


# ---------------------------------------------------------------- L5 / L7

# Wording of the trigger mail, in lines.
MAIL_LINES = ["🚨 ALERTE CRYPTO DÉCLENCHÉE 🚨", "", "Nom de l'alerte: %s", "Symbole: %s", "Date: %s", "",
              "CONDITIONS REMPLIES:", "%s"]


def trigger_notices(fired: DataFrame, alerts: DataFrame, signature: str = "") -> DataFrame:
    """The notice sent when an alert fires – ``type='alert_triggered'``,
    id, name, status – plus the mail subject, recipient, first condition's
    symbol (or 'N/A'), the conditions as text lines and the mail body, dated
    with the trigger instant and closed by the sender's ``signature``."""
    a = alerts.select(F.col("id").alias("a_id"), "conditions")
    j = fired.join(a, fired["id"] == a["a_id"], "left").drop("a_id")
    lines = F.transform("conditions", lambda c: F.concat(
        F.lit("  • "), F.coalesce(c["symbol"], F.lit("N/A")), F.lit(": "),
        F.replace(c["type"], F.lit("_"), F.lit(" ")), F.lit(" "),
        F.coalesce(c["threshold"], F.lit(""))))
    symbol = F.coalesce(F.try_element_at("conditions", F.lit(1))["symbol"], F.lit("N/A"))
    when = F.date_format("trigger_ts", "dd/MM/yyyy HH:mm:ss") if "trigger_ts" in fired.columns else F.lit("")
    return j.select(F.lit("alert_triggered").alias("type"), F.col("id").alias("alert_id"),
                    F.col("name").alias("alert_name"), F.lit("triggered").alias("status"),
                    F.col("email").alias("to_email"),
                    F.concat(F.lit(MAIL_SUBJECT_PREFIX), F.col("name")).alias("subject"),
                    symbol.alias("symbol"), F.array_join(lines, "\n").alias("conditions_text"),
                    F.concat(F.format_string("\n".join(MAIL_LINES), F.col("name"), symbol, when,
                                             F.array_join(lines, "\n")), F.lit(signature)).alias("body"))


def alert_status(alerts: DataFrame, fired: DataFrame) -> DataFrame:
    """Registry with ``status`` / ``triggered`` after a batch of triggers."""
    f = fired.select(F.col("id").alias("f_id")).distinct()
    j = alerts.join(f, alerts["id"] == f["f_id"], "left")
    hit = F.col("f_id").isNotNull() | F.coalesce(F.col("triggered"), F.lit(False))
    return j.select("id", "name", "email",
                    F.when(hit, "triggered").otherwise("active").alias("status"),
                    hit.alias("triggered"))
