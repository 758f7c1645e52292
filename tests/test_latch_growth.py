"""The first-trigger latch: its rows follow the updates, not the conditions; the
stream latch: an update touches the thresholds it crosses."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from marketlens.operators import alerts as al
from marketlens.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
FIELDS = "symbol string, ts timestamp_ntz, event_id long, price double, volume double, volatility double, rsi double, macd double, bollinger_upper double, bollinger_lower double"
ALERTS = "id string, name string, conditions array<struct<symbol:string,type:string,threshold:string>>, email string, status string, triggered boolean"


def timeline(rng, n=6000, symbols=3, gap=60):
    rows = []
    for i in range(n):
        s = f"S{rng.choice([0] * 4 + list(range(symbols)))}"
        p = rng.gauss(100, 20)
        rows.append((s, T0 + dt.timedelta(seconds=gap * i), i, p, float(rng.randint(1, 9)), rng.choice([None, rng.random() * 60]), rng.choice([None, rng.random() * 100]), rng.gauss(0, 5), p + rng.gauss(5, 5), p - rng.gauss(5, 5)))
    return rows


def registry(rng, n, symbols=3):
    kinds = [("price_above", (60, 175)), ("price_below", (25, 140)), ("rsi_above", (30, 99.9)), ("rsi_below", (0.1, 70)), ("volume_above", (0, 8)), ("volatility_above", (0, 60)), ("macd_positive", None), ("bollinger_upper", None), ("bollinger_lower", None)]
    out, i = [], 0
    while i < n:
        k = rng.choice([1, 1, 2, 3])
        conds = []
        for _ in range(k):
            kind, span = rng.choice(kinds)
            conds.append((f"S{rng.randrange(symbols)}", kind, "" if span is None else repr(rng.uniform(*span))))
        out.append((f"a{len(out)}", f"a{len(out)}", conds, "e", "active", False))
        i += k
    return out


def holds(cond, state):
    s = state.get(cond[0])
    if s is None:
        return False
    y = float(cond[2] or 0)
    price, volume, volatility, rsi, macd, up, low = s
    v, test = {"price_above": (price, lambda x: x > y), "price_below": (price, lambda x: x < y), "rsi_above": (rsi, lambda x: x > y), "rsi_below": (rsi, lambda x: x < y),
               "volume_above": (volume, lambda x: x > y), "volatility_above": (volatility, lambda x: x > y), "macd_positive": (macd, lambda x: x > 0),
               "bollinger_upper": (price, lambda x: x - up * 0.99 >= 0), "bollinger_lower": (price, lambda x: low * 1.01 - x >= 0)}[cond[1]]
    return v is not None and test(v)


def brute(alerts, rows):
    state, fired = {}, {}
    for r in rows:
        state[r[0]] = r[3:]
        for a in alerts:
            if a[0] not in fired and all(holds(c, state) for c in a[2]):
                fired[a[0]] = r[2]
    return fired


def rows_made(plan):
    """Output rows of all operators of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_made(plan.executedPlan())
    total = 0
    if plan.metrics().contains("numOutputRows"):
        total += plan.metrics().apply("numOutputRows").value()
    if kind.endswith("QueryStageExec"):
        return total + rows_made(plan.plan())
    if kind == "ReusedExchangeExec":
        return total
    children = plan.children()
    return total + sum(rows_made(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("bucket,gap", [("hour", 60), ("minute", 17), ("day", 600)])
def test_first_trigger_equals_brute_force(spark, bucket, gap):
    rng = random.Random(gap)
    rows, alerts = timeline(rng, 900, gap=gap), registry(rng, 120)
    got = al.first_trigger(spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(rows, FIELDS), bucket=bucket)
    assert {r.id: r.trigger_event_id for r in got.collect()} == brute(alerts, rows)


def test_quiet_symbols_keep_their_state(spark):
    # Q is quiet for days; its state holds when the other symbol moves
    row = lambda s, day, i, p: (s, T0 + dt.timedelta(days=day), i, p, 1.0, None, None, None, None, None)
    rows = [row("Q", 0, 1, 50.0), row("M", 1, 2, 5.0), row("M", 6, 3, 500.0), row("Q", 9, 4, 1.0), row("M", 12, 5, 900.0)]
    both = lambda y: [("Q", "price_above", "40"), ("M", "price_above", y)]
    alerts = [("a", "a", both("400"), "e", "active", False), ("b", "b", both("600"), "e", "active", False),
              ("c", "c", [("Q", "price_below", "2"), ("M", "price_above", "600")], "e", "active", False)]
    got = al.first_trigger(spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(rows, FIELDS))
    assert {r.id: r.trigger_event_id for r in got.collect()} == {"a": 3, "c": 5} == brute(alerts, rows)


def test_rows_do_not_grow_with_the_conditions(spark, scratch):
    rng = random.Random(8)
    spark.createDataFrame(timeline(rng), FIELDS).write.parquet(scratch + "/tl")
    tl = spark.read.parquet(scratch + "/tl")
    made = {}
    for n in (100, 1000):
        spark.createDataFrame(registry(rng, n), ALERTS).write.parquet(f"{scratch}/r{n}")
        df = al.first_trigger(spark.read.parquet(f"{scratch}/r{n}"), tl, bucket="day")
        df.collect()
        made[n] = rows_made(df._jdf.queryExecution().executedPlan())
    assert made[1000] < 2 * made[100], made


@pytest.mark.parametrize("piece", [1, 3, 50])
def test_first_trigger_in_pieces_of_a_bucket(spark, monkeypatch, piece):
    # several symbols move at one instant, so that pieces end inside instants
    monkeypatch.setattr(al, "CHECK_ROWS", piece)
    rng = random.Random(piece)
    rows = [(r[0], T0 + dt.timedelta(seconds=60 * (i // 3)), i // 3, *r[3:]) for i, r in enumerate(timeline(rng, 600, symbols=4))]
    rows = list({(r[0], r[2]): r for r in rows}.values())
    alerts = registry(rng, 100, symbols=4)
    got = al.first_trigger(spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(rows, FIELDS), bucket="day")
    # all updates of an instant hold together
    state, fired = {}, {}
    for i in sorted({r[2] for r in rows}):
        state.update({r[0]: r[3:] for r in rows if r[2] == i})
        for a in alerts:
            if a[0] not in fired and all(holds(c, state) for c in a[2]):
                fired[a[0]] = i
    assert {r.id: r.trigger_event_id for r in got.collect()} == fired


def test_missing_instants_and_symbols(spark):
    row = lambda s, t, i, p: (s, t, i, p, 1.0, None, None, None, None, None)
    rows = [row("A", None, None, 1.0), row("B", None, 2 ** 53 + 1, 9.0), row(None, T0, 3, 50.0), row("A", T0, None, 7.0), row("B", T0, 2 ** 53 + 3, 3.0)]
    alerts = [("a", "a", [("A", "price_above", "5")], "e", "active", False), ("b", "b", [("B", "price_above", "5")], "e", "active", False),
              ("c", "c", [("A", "price_above", "5"), ("B", "price_below", "5")], "e", "active", False)]
    got = al.first_trigger(spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(rows, FIELDS))
    assert {r.id: (r.trigger_ts, r.trigger_event_id) for r in got.collect()} == {"a": (T0, None), "b": (None, 2 ** 53 + 1), "c": (T0, 2 ** 53 + 3)}


def test_memory_does_not_grow_with_the_rows_of_a_bucket():
    rng, most = np.random.default_rng(1), {}
    test = {"symbol": "A", "base": "price", "sign": 1.0, "strict": True, "y": 1e9}
    for n in (20, 200):
        held = []

        def batches(n=n, held=held):
            def batch(kind, rows, **own):
                given = {"bucket": pa.array([T0] * rows, pa.timestamp("us")), "slice": pa.array([0] * rows, pa.int32()), "kind": pa.array([kind] * rows, pa.int32()),
                         "ts": pa.nulls(rows, pa.timestamp("us")), "event_id": pa.nulls(rows, pa.int64()), "symbol": pa.nulls(rows, pa.string()),
                         "id": pa.nulls(rows, pa.string()), "tests": pa.array([[test]] * rows), **{b: pa.nulls(rows, pa.float64()) for b in al.AXIS_BASES}}
                return pa.RecordBatch.from_pydict(given | own)

            start = pa.total_allocated_bytes()
            yield batch(0, 1, id=pa.array(["a"]))
            for k in range(n):
                held.append(pa.total_allocated_bytes() - start)
                ids = np.arange(1000 * k, 1000 * k + 1000)
                prices = {b: pa.array(rng.normal(size=1000)) for b in al.AXIS_BASES}
                if k == n - 1:
                    prices["price"] = pa.array([0.0] * 998 + [2e9, 3e9])
                yield batch(2, 1000, ts=pa.array(ids, pa.timestamp("us")), event_id=pa.array(ids), symbol=pa.array(["A"] * 1000), **prices)

        found = [x for part in al._check_buckets(batches(), ["ts", "event_id"], 5000) for x in part.to_pylist()]
        assert [(x["id"], x["event_id"]) for x in found] == [("a", 1000 * n - 2)]
        most[n] = max(held)
    assert most[200] < 1.5 * most[20], most


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Map:
    def __init__(self):
        self.own, self.read = {}, []

    def updateValue(self, key, value):
        self.own[key] = value

    def getValue(self, key):
        self.read.append(key)
        return self.own[key]


class _Handle:
    def getValueState(self, *_):
        return _Value()

    def getMapState(self, *_):
        return _Map()


def test_an_update_reads_and_writes_what_it_crosses(monkeypatch):
    monkeypatch.setattr(stateful, "INDEX_PIECE", 10)
    p = stateful._Crossings()
    p.init(_Handle())
    ys = np.arange(1000.0)
    p.handleInitialState(("S", "price>"), pd.DataFrame({"y": ys[::-1], "id": [f"a{int(y)}" for y in ys[::-1]], "n": 1}), None)
    step = lambda *us: pd.concat([pd.DataFrame({"id": [], "delta": []}), *p.handleInputRows(("S", "price>"), iter([pd.DataFrame(
        {"u": us, "ts": pd.Timestamp("2024-01-01"), "event_id": range(len(us)), "released": pd.NaT})]), None)])
    assert len(step(500.0)) == 500                      # from below all: thresholds 0 to 499
    p.index.read.clear()
    out = step(503.5, 501.0)
    assert list(zip(out["id"], out["delta"], strict=True)) == [("a500", 1), ("a501", 1), ("a502", 1), ("a503", 1), ("a501", -1), ("a502", -1), ("a503", -1)]
    assert set(p.index.read) <= {(49,), (50,)}
    p.index.read.clear()
    assert len(step(501.0)) == 0 and p.index.read == []  # nothing moved


def test_volume_baseline_spreads_over_chunks(spark):
    from marketlens.operators.stats import with_volume_baseline
    rng = random.Random(2)
    rows = [("B" if rng.random() < 0.9 else None, T0 + dt.timedelta(seconds=5 * i), rng.randint(0, 9)) for i in range(40_000)]
    s = spark.createDataFrame(rows, "symbol string, window_start timestamp_ntz, trade_count long")
    got = {(r.symbol, r.window_start): r.avg_trade_count for r in with_volume_baseline(s, "hour").collect()}
    seen = {}
    for symbol, at, n in rows:
        own = seen.setdefault(symbol, [0, 0])
        want = own[1] / own[0] if own[0] else None
        assert got[symbol, at] == (None if want is None else pytest.approx(want, rel=1e-12))
        own[0], own[1] = own[0] + 1, own[1] + n
    plan = with_volume_baseline(s, "hour")._jdf.queryExecution().optimizedPlan().toString()
    # the frame over the rows is cut by time; only the table of chunks has one per symbol
    assert plan.count("_chunk") and len([x for x in plan.splitlines() if "Window" in x and "trade_count" in x and "_chunk" in x]) >= 1
