"""Hand fixtures for operator semantics and the reference quirks (FIXTURES §2)."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)

from marketlens.functions import normalize as nz
from marketlens.functions import parse as ps
from marketlens.functions import signals as sg
from marketlens.operators import alerts as al
from marketlens.operators import arbitrage as ab
from marketlens.operators import indicators as ind
from marketlens.operators import rules as ru
from marketlens.operators import serving as sv
from marketlens.operators.stats import window_stats, with_volume_baseline
from marketlens.schemas import USER_ALERT

TRADE = StructType([StructField("event_id", LongType()), StructField("symbol", StringType()),
                    StructField("exchange", StringType()), StructField("price", DoubleType()),
                    StructField("volume", DoubleType()), StructField("ts", TimestampNTZType())])
T0 = datetime(2024, 1, 1, 0, 0, 0)


def trades(spark, rows):
    """rows: (symbol, price, seconds, [exchange, volume])."""
    out = []
    for i, r in enumerate(rows):
        sym, price, sec = r[:3]
        ex = r[3] if len(r) > 3 else "binance"
        vol = r[4] if len(r) > 4 else 1.0
        out.append((i, sym, ex, price, vol, T0 + timedelta(seconds=sec)))
    return spark.createDataFrame(out, TRADE)


# ------------------------------------------------------------------ A1/A2

def test_window_stats_edges(spark):
    t = trades(spark, [("A", 10.0, 0), ("A", 20.0, 299), ("A", 30.0, 300), ("B", None, 10),
                       ("C", 0.0, 5), ("C", 0.0, 6)])
    s = {(r.symbol, r.window_start): r for r in window_stats(t, "5 minutes").collect()}
    a0 = s[("A", T0)]
    assert (a0.trade_count, a0.avg_price, a0.min_price, a0.max_price) == (2, 15.0, 10.0, 20.0)
    assert a0.trend == pytest.approx(10 / 15 * 100)
    a1 = s[("A", T0 + timedelta(minutes=5))]            # edge row opens the next window
    assert a1.trade_count == 1 and a1.volatility is None
    b = s[("B", T0)]
    assert b.trade_count == 0 and b.avg_price is None   # all-null prices
    assert s[("C", T0)].trend is None                    # zero mean -> NULL trend


def test_volume_baseline(spark):
    t = trades(spark, [("A", 1.0, 0), ("A", 1.0, 1), ("A", 1.0, 400), ("A", 1.0, 700),
                       ("A", 1.0, 701), ("A", 1.0, 702)])
    rows = with_volume_baseline(window_stats(t, "5 minutes")).orderBy("window_start").collect()
    assert [r.avg_trade_count for r in rows] == [None, 2.0, 1.5]


# ------------------------------------------------------------------ W1-W12

def _py_rsi(prices, period=14):
    out, gains, losses = [], [], []
    for i, p in enumerate(prices):
        chg = p - prices[i - 1] if i else None
        gains.append(chg if chg is not None and chg > 0 else 0.0)
        losses.append(-chg if chg is not None and chg < 0 else 0.0)
        g = gains[max(0, i - period): i + 1]
        lo = losses[max(0, i - period): i + 1]
        ag, al_ = sum(g) / len(g), sum(lo) / len(lo)
        out.append(None if al_ == 0 else 100 - 100 / (1 + ag / al_))
    return out


@pytest.mark.parametrize("block_rows", [None, 64, 1000])
def test_rsi_matches_replay(spark, block_rows):
    prices = [10, 11, 12, 11, 13, 13, 12, 15, 14, 16, 18, 17, 17, 19, 20, 18, 21, 22, 20, 19,
              23, 25, 24, 26, 22, 21, 27, 28, 26, 30] * 4
    t = trades(spark, [("A", float(p), i) for i, p in enumerate(prices)])
    got = [r.rsi for r in ind.rsi(t, block_rows=block_rows).orderBy("event_id").collect()]
    exp = _py_rsi([float(p) for p in prices])
    for g, e in zip(got, exp):
        assert (g is None) == (e is None)
        if e is not None:
            assert g == pytest.approx(e, abs=1e-9)


def test_rsi_null_cases(spark):
    rise = trades(spark, [("A", float(i), i) for i in range(20)])
    assert all(r.rsi is None for r in ind.rsi(rise).collect())      # mean loss 0
    flat = trades(spark, [("A", 5.0, i) for i in range(20)])
    assert all(r.rsi is None for r in ind.rsi(flat).collect())


def test_bands_constant_and_short(spark):
    flat = trades(spark, [("A", 5.0, i) for i in range(25)])
    rows = ind.enrich(flat).orderBy("event_id").collect()
    assert rows[0].upper_band is None and rows[0].bb_position is None   # 1 row: NULL stddev
    assert all(r.upper_band == r.lower_band == 5.0 for r in rows[1:])
    assert all(r.bb_position is None for r in rows)                   # zero-width band
    assert all(r.macd_line == 0.0 for r in rows)
    short = trades(spark, [("A", float(p), i) for i, p in enumerate([1, 2, 3, 4, 5])])
    r = ind.macd(short).orderBy("event_id").collect()[-1]
    assert r.macd_line == pytest.approx(0.0)                          # both means over 5 rows


def _live(spark, prices, block_rows):
    t = trades(spark, [("BTCUSDT", p, i) for i, p in enumerate(prices)])
    return ind.live_indicators(t, block_rows=block_rows).orderBy("event_id").collect()


@pytest.mark.parametrize("block_rows", [None, 64, 1000])
def test_live_indicators_worked_values(spark, block_rows):
    """W7-W9 by hand: 30 ticks up by 1, then down by 1."""
    prices = [100.0 + min(i, 58 - i) for i in range(90)]
    rows = _live(spark, prices, block_rows)
    assert rows[0].coin == "BTC"
    assert all(r.live_rsi == r.live_macd == r.bollinger_middle == 0.0 for r in rows[:13])
    # 14 ticks: 13 gains of 1, /14, no loss (divides by 1): 100 - 100 / (1 + 13/14)
    assert rows[13].live_rsi == 48.1
    # means of the last 12 and of all 14 consecutive prices lie 1 apart
    assert rows[13].live_macd == 1.0
    # 14 consecutive integers: mean 6.5 below the last, variance (14^2 - 1) / 12
    assert (rows[13].bollinger_middle, rows[13].bollinger_upper) == (106.5, 114.56)
    # 30 ticks: 12 and 26 consecutive prices, means 7 apart; 20 prices, variance 399 / 12
    assert (rows[29].live_rsi, rows[29].live_macd) == (48.1, 7.0)
    assert (rows[29].bollinger_middle, rows[29].bollinger_lower) == (119.5, 107.97)
    # 50 prices kept: the oldest 14 are still the first ones
    assert rows[49].live_rsi == 48.1
    # ticks 20 to 69 are kept; their first 13 changes are 9 up and 4 down: rs = 9/4
    assert rows[69].live_rsi == 69.2
    # ticks 40 to 89 are kept: 13 losses and no gain
    assert (rows[89].live_rsi, rows[89].live_macd) == (0.0, -7.0)


@pytest.mark.parametrize("shift", [0.0, 50.0])
def test_live_indicators_do_not_depend_on_the_price_level(spark, shift):
    import random
    rnd = random.Random(3)
    moves = [round(rnd.uniform(-1, 1), 2) for _ in range(120)]
    rows = _live(spark, [200.0 + shift + sum(moves[:i + 1]) for i in range(120)], 64)
    base = _live(spark, [200.0 + sum(moves[:i + 1]) for i in range(120)], None)
    for r, q in zip(rows, base):
        assert r.live_rsi == pytest.approx(q.live_rsi, abs=0.1001)
        assert r.live_macd == pytest.approx(q.live_macd, abs=1.001e-4)
        if q.event_id >= 13:
            assert r.bollinger_upper - shift == pytest.approx(q.bollinger_upper, abs=0.01001)
            assert r.bollinger_lower <= r.bollinger_middle <= r.bollinger_upper


def test_tick_change_and_direction(spark):
    t = trades(spark, [("A", 100.0, 0), ("A", 0.0, 1), ("A", 110.0, 2), ("A", 99.0, 3),
                       ("A", 99.0, 4)])
    rows = ind.tick_change(t).orderBy("event_id").collect()
    assert [r.change_pct for r in rows] == [0.0, 10.0, -10.0, 0.0]   # zero price skipped
    assert [r.direction for r in rows] == ["flat", "up", "down", "flat"]


def test_signals(spark):
    df = spark.createDataFrame([(75.0, 0.0, 0.9), (25.0, -1.0, 0.1), (50.0, 1.0, 0.5)],
                               "rsi double, macd double, bb double")
    r = df.select(sg.rsi_signal("rsi").alias("a"), sg.macd_signal("macd").alias("b"),
                  sg.macd_signal("macd", strict=True).alias("c"), sg.bb_signal("bb").alias("d"),
                  sg.severity_style(F.lit("HIGH"))["chat_color"].alias("e")).collect()
    assert [tuple(x) for x in r] == [("overbought", "bullish", "bearish", "overbought", "danger"),
                                     ("oversold", "bearish", "bearish", "oversold", "danger"),
                                     ("neutral", "bullish", "bullish", "normal", "danger")]


# ------------------------------------------------------------------ A4-A8, P11

def test_arbitrage_cases(spark):
    rows = [
        ("ONE", 100.0, 0, "a", 1.0), ("ONE", 101.0, 1, "a", 1.0),          # one venue
        ("SOLO", 100.0, 0, "a", 1.0),                                       # one trade
        ("LOW", 100.0, 0, "a", 1.0), ("LOW", 100.4, 1, "b", 1.0),          # 0.4 %
        ("EDGE", 100.0, 0, "a", 1.0), ("EDGE", 100.5, 1, "b", 1.0),        # 0.5 %: strict
        ("HIGH", 100.0, 0, "a", 2.0), ("HIGH", 102.0, 1, "b", 3.0),        # 2 %
        ("ZERO", 100.0, 0, "a", 0.0), ("ZERO", 200.0, 1, "b", 1.0),        # zero-volume venue
        ("EQ", 100.0, 0, "a", 1.0), ("EQ", 100.0, 1, "b", 1.0),            # equal prices
        ("TIE", 100.0, 0, "c", 1.0), ("TIE", 100.0, 1, "a", 1.0), ("TIE", 110.0, 2, "b", 1.0),
        ("TIE", 110.0, 3, "d", 1.0),
    ]
    out = {r.symbol: r for r in ab.arbitrage(trades(spark, rows), "1 minute").collect()}
    assert set(out) == {"HIGH", "TIE"}
    h = out["HIGH"]
    assert (h.buy_exchange, h.sell_exchange, h.potential_volume) == ("a", "b", 2.0)
    assert h.arbitrage_percentage == pytest.approx(2.0)
    assert h.potential_profit_usd == pytest.approx(4.0)
    assert (out["TIE"].buy_exchange, out["TIE"].sell_exchange) == ("a", "d")
    big = ab.arbitrage(trades(spark, rows), "1 minute", min_notional=150.0).collect()
    assert [r.symbol for r in big] == ["HIGH"]


def test_symbol_modes(spark):
    df = spark.createDataFrame([("btcusdt",), ("btcusd",), ("ethusd",)], "s string")
    r = df.select(nz.normalize_symbol("s", "suffix").alias("a"),
                  nz.normalize_symbol("s", "literal").alias("b")).collect()
    assert [tuple(x) for x in r] == [("btc", "btct"), ("btc", "btc"), ("eth", "eth")]
    assert df.select(nz.coin_of(F.upper("s"))).first()[0] == "BTC"


# ------------------------------------------------------------------ R1-R8, S9

def test_rules_fire_skip_and_null(spark):
    df = spark.createDataFrame(
        [("A", 25.0, 10.0, 12.0, 8.0, 1.0, 0.5, 0.2, 0.6),
         ("B", 75.0, 7.0, 12.0, 8.0, 0.1, 0.5, 0.2, 0.1),
         ("C", None, None, None, None, None, None, None, None)],
        "symbol string, rsi double, price double, upper_band double, lower_band double, "
        "macd_line double, signal_line double, prev_macd_line double, prev_signal_line double")
    got = {(r.symbol, r.rule_name) for r in ru.evaluate_rules(df).collect()}
    assert got == {("A", "rsi_oversold"), ("A", "macd_signal"), ("B", "rsi_overbought"),
                   ("B", "price_breakout")}
    # volatility / trade_count rules are skipped: their columns are absent
    assert {r["rule_name"] for r in ru.applicable_rules(df)} == {
        "rsi_oversold", "rsi_overbought", "price_breakout", "macd_signal"}


def test_outbox_channels(spark):
    df = spark.createDataFrame([("A", 0.5)], "symbol string, volatility double")
    box = ru.notification_outbox(ru.evaluate_rules(df)).collect()
    assert sorted(r.channel for r in box) == ["email", "kafka"]
    mail = [r for r in box if r.channel == "email"][0]
    assert mail.subject == "Alerte A - HIGH" and mail.topic is None
    kafka = [r for r in box if r.channel == "kafka"][0]
    assert kafka.topic == "binance-alerts" and kafka.key == "A"


# ------------------------------------------------------------------ L1-L7

STATE = "symbol string, price double, volume double, volatility double, rsi double, " \
        "macd double, bollinger_upper double, bollinger_lower double"


def _alerts(spark, items):
    rows = [(i, i, [dict(symbol=s, type=t, threshold=th) for s, t, th in conds], "x@y", "active",
             trig) for i, conds, trig in items]
    return spark.createDataFrame(rows, USER_ALERT)


def test_condition_types(spark):
    state = spark.createDataFrame([("A", 100.0, 5.0, 2.0, 25.0, 0.5, 101.0, 99.5),
                                   ("B", 50.0, None, None, None, -0.1, None, None)], STATE)
    cases = [
        ("price_above", "A", "99", True), ("price_above", "A", "100", False),
        ("price_below", "A", "101", True), ("volatility_above", "A", "1.5", True),
        ("volume_above", "A", "5", False), ("rsi_above", "A", "20", True),
        ("rsi_below", "A", "30", True), ("macd_positive", "A", "", True),
        ("macd_negative", "B", "", True), ("bollinger_upper", "A", "", True),
        ("bollinger_lower", "A", "", True), ("price_above", "A", "", True),   # '' -> 0
        ("price_above", "A", "abc", False), ("nonsense", "A", "1", False),
        ("price_above", "ZZZ", "1", False), ("rsi_above", "B", "1", False),  # NULL operand
        ("volatility_below", "A", "5", False),
    ]
    items = [(f"c{i}", [(s, ty, th)], False) for i, (ty, s, th, _) in enumerate(cases)]
    items += [("none", [], False), ("two", [("A", "price_above", "1"), ("B", "price_below", "60")], False),
              ("done", [("A", "price_above", "1")], True)]
    res = {r.id: r.fired for r in al.evaluate_alerts(_alerts(spark, items), state).collect()}
    for i, (_, _, _, exp) in enumerate(cases):
        assert res[f"c{i}"] is exp, cases[i]
    assert res["none"] is True and res["two"] is True and "done" not in res
    zero = {r.id: r.fired for r in al.evaluate_alerts(_alerts(spark, items), state,
                                                       zero_default=True).collect()}
    assert zero["c15"] is False and zero["c16"] is False
    vb = {r.id: r.fired for r in al.evaluate_alerts(_alerts(spark, items), state,
                                                     volatility_below=True).collect()}
    assert vb["c16"] is True


def test_first_trigger_latch(spark):
    tl_schema = "symbol string, ts timestamp_ntz, event_id long, " + STATE.split(", ", 1)[1]
    def row(i, sym, price, macd=0.0):
        return (sym, T0 + timedelta(seconds=i), i, price, 1.0, 1.0, 50.0, macd, 200.0, 1.0)
    tl = spark.createDataFrame([row(0, "A", 10.0), row(1, "B", 5.0), row(2, "A", 20.0),
                                row(3, "B", 7.0), row(4, "A", 9.0), row(5, "A", 30.0),
                                row(6, "B", 8.0, 1.0)], tl_schema)
    items = [("a", [("A", "price_above", "15")], False),
             ("ab", [("A", "price_above", "15"), ("B", "price_above", "6")], False),
             ("never", [("A", "price_above", "100")], False),
             ("macd", [("B", "macd_positive", "")], False),
             ("none", [], False), ("gone", [("A", "price_above", "1")], True)]
    got = {r.id: r.trigger_event_id for r in al.first_trigger(_alerts(spark, items), tl).collect()}
    assert got == {"a": 2, "ab": 3, "macd": 6, "none": 0}


def test_registry_and_notices(spark):
    reg = _alerts(spark, [("old_0", [("A", "price_above", "1")], False)])
    new = spark.createDataFrame(
        [("n1", [dict(symbol="A", type="price_above", threshold=""),
                 dict(symbol="A", type="macd_positive", threshold="")], "m@x", 0),
         ("", [dict(symbol="A", type="price_above", threshold="1")], "m@x", 1),
         ("n3", [dict(symbol="A", type="price_above", threshold="")], "m@x", 2)],
        StructType([StructField("name", StringType()), StructField("conditions", USER_ALERT["conditions"].dataType),
                    StructField("email", StringType()), StructField("seq", LongType())]))
    out = {r.id: len(r.conditions) for r in al.create_alerts(reg, new).collect()}
    assert out == {"old_0": 1, "n1_1": 1}
    gone = al.delete_alerts(al.create_alerts(reg, new), spark.createDataFrame([("old_0",)], "id string"))
    assert [r.id for r in gone.collect()] == ["n1_1"]
    fired = spark.createDataFrame([("old_0", "old_0", "x@y")], "id string, name string, email string")
    n = al.trigger_notices(fired, reg).first()
    assert (n.type, n.status, n.symbol) == ("alert_triggered", "triggered", "A")
    assert n.conditions_text == "  • A: price above 1"
    st = {r.id: r.status for r in al.alert_status(reg, fired).collect()}
    assert st == {"old_0": "triggered"}


# ------------------------------------------------------------------ O1-O5, A9-A16

def test_serving(spark):
    t = trades(spark, [("A", 1.0, 0), ("B", 2.0, 1), ("A", 3.0, 2), ("A", 4.0, 3)])
    assert [r.event_id for r in sv.recent_trades(t, 2).collect()] == [3, 2]
    assert {r.symbol: r.price for r in sv.latest_trade(t).collect()} == {"A": 4.0, "B": 2.0}
    a = sv.list_trades(t, 2, "B", "A").collect()
    b = sv.list_trades(t, 2, "B", "B").collect()
    assert a == [] and [r.event_id for r in b] == [1]
    h = sv.health(t, window_stats(t, "1 hour")).first()
    assert (h.buffered_trades, h.symbols_with_stats, h.active_alerts) == (4, 2, 0)
    assert sv.symbol_detail(window_stats(t, "1 hour"), t, "Z", "B").count() == 0


# ------------------------------------------------------------------ P1-P9 negative cases

def test_parsers_negative(spark):
    raw = spark.createDataFrame([
        ("not json",), ('{"stream":"x@aggTrade"}',),
        ('{"stream":"btcusdt@aggTrade","data":{"s":"BTCUSDT","p":"abc","E":"1"}}',),
        ('{"stream":"btcusdt@aggTrade","data":{"s":"BTCUSDT","p":"1.5","E":null}}',),
        ('{"stream":"btcusdt@markPrice","data":{"s":"BTCUSDT","p":"2","E":"1000"}}',)], "value string")
    env = ps.valid_envelope(ps.classify_stream(ps.parse_json_envelope(raw)))
    assert env.count() == 3
    ticks = ps.parse_envelope(raw, keep_kind=True).collect()
    assert ticks[2].price is None and ticks[3].timestamp is None and ticks[4].kind == "mark"
    marks = ps.mark_prices(ps.parse_json_envelope(raw)).collect()
    assert [(m.symbol, m.funding_rate) for m in marks] == [("BTCUSDT", "0")]
    cb = spark.createDataFrame([
        ('{"type":"match","product_id":"BTC-USD","price":"1","size":"2","trade_id":7}', "2024-01-01T00:00:00"),
        ('{"type":"heartbeat","product_id":"BTC-USD"}', "2024-01-01T00:00:00")],
        "value string, ingest_time string")
    c = ps.normalize_coinbase(cb).collect()
    assert len(c) == 1 and c[0].symbol == "btcusd" and c[0].timestamp == "2024-01-01T00:00:00"
    kr = spark.createDataFrame([
        ('[1,[["5.0","0.1","1.0","b","l",""],["6","1"]],"trade","XBT/USD"]', "t"),
        ('{"event":"heartbeat"}', "t"), ('[1,[],"trade","XBT/USD"]', "t"),
        ('[1,[["7","2"]]]', "t")], "value string, ingest_time string")
    k = ps.normalize_kraken(kr).collect()
    assert [(r.symbol, r.price) for r in k] == [("btcusd", 5.0), ("unknown", 7.0)]
    assert [r.symbol for r in ps.normalize_kraken(kr, canonical=False).collect()] == ["xbt/usd", "unknown"]


def test_fan_out_doubles_rows(spark):
    from marketlens.streaming.sinks import fan_out_topics
    u = spark.createDataFrame([("binance", "btcusdt", 1.0, 1.0, "t", "1")],
                              "exchange string, symbol string, price double, volume double, "
                              "timestamp string, trade_id string")
    topics = sorted(r.topic for r in fan_out_topics(u).collect())
    assert topics == ["all-exchanges", "exchange-binance"]


def test_running_total_matches_window(spark):
    from pyspark.sql import Window
    from marketlens.operators.frames import running_total
    rows = [("hot" if i % 3 else "cold", T0 + timedelta(seconds=7 * (i // 2)), i // 2,
             (1 if i % 5 else -2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, ts timestamp_ntz, event_id long, delta long")
    got = {(r.id, r.event_id): r.total for r in running_total(df, ["id"]).collect()}
    w = (Window.partitionBy("id").orderBy("ts", "event_id")
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    exp = {(r.id, r.event_id): r.t for r in
           df.select("id", "event_id", F.sum("delta").over(w).alias("t")).distinct().collect()}
    assert got == exp


def test_first_trigger_many_thresholds_brute_force(spark):
    """200+ thresholds per symbol (several search buckets) vs a sequential replay."""
    import random
    rnd = random.Random(7)
    tl_schema = "symbol string, ts timestamp_ntz, event_id long, " + STATE.split(", ", 1)[1]
    rows, state = [], {}
    for i in range(400):
        sym = rnd.choice(["A", "B"])
        price = round(rnd.uniform(0, 100), 1)
        rsi = None if i % 17 == 0 else round(rnd.uniform(0, 100), 1)
        rows.append((sym, T0 + timedelta(seconds=i), i, price, 1.0, 1.0, rsi, price - 50,
                     90.0, 10.0))
    tl = spark.createDataFrame(rows, tl_schema)
    items = []
    for a in range(240):
        conds = [(rnd.choice(["A", "B"]), rnd.choice(["price_above", "price_below", "rsi_above"]),
                  str(round(rnd.uniform(0, 100), 1)))]
        if a % 3 == 0:
            conds.append((rnd.choice(["A", "B"]), "rsi_below", str(round(rnd.uniform(0, 100), 1))))
        if a % 7 == 0:
            conds.append(("B", "macd_positive", ""))
        items.append((f"a{a}", conds, False))
    got = {r.id: r.trigger_event_id for r in al.first_trigger(_alerts(spark, items), tl).collect()}
    exp = {}
    for sym, _, i, price, _, _, rsi, macd, _, _ in rows:
        state[sym] = {"price": price, "rsi": rsi, "macd": macd}
        for aid, conds, _ in items:
            if aid in exp:
                continue
            def met(s, ty, th):
                st = state.get(s)
                if st is None:
                    return False
                x = float(th) if th else 0.0
                v = {"price_above": st["price"], "price_below": st["price"],
                     "rsi_above": st["rsi"], "rsi_below": st["rsi"], "macd_positive": st["macd"]}[ty]
                if v is None:
                    return False
                return {"price_above": v > x, "price_below": v < x, "rsi_above": v > x,
                        "rsi_below": v < x, "macd_positive": v > 0}[ty]
            if all(met(*c) for c in conds):
                exp[aid] = i
    assert got == exp


def test_running_window_stats_matches_window(spark):
    import random
    from pyspark.sql import Window
    rnd = random.Random(5)
    rows = []
    for i in range(1500):
        sym = rnd.choice(["A", "B"])
        price = 50.0 if sym == "B" else round(rnd.uniform(10, 1000), 2)   # B: constant
        rows.append((sym, price if i % 97 else None, rnd.randint(0, 3600)))
    t = spark.createDataFrame(
        [(i, s, "x", p, 1.0, T0 + timedelta(seconds=sec)) for i, (s, p, sec) in enumerate(rows)], TRADE)
    got = {r.event_id: (r.volume, r.volatility) for r in al.running_window_stats(t).collect()}
    w = (Window.partitionBy("symbol", F.window("ts", "5 minutes").start).orderBy("ts", "event_id")
         .rowsBetween(Window.unboundedPreceding, 0))
    exp = {r.event_id: (r.v, r.s) for r in t.select(
        "event_id", F.count("price").over(w).cast("double").alias("v"),
        F.stddev("price").over(w).alias("s")).collect()}
    assert got.keys() == exp.keys()
    for k, (v, sd) in exp.items():
        gv, gs = got[k]
        assert gv == v
        assert (gs is None) == (sd is None), k
        if sd is not None:
            assert gs == pytest.approx(sd, rel=1e-9, abs=1e-9)
    assert all(got[k][1] in (None, 0.0) for k, (s, p, _) in enumerate(rows) if s == "B")


def test_state_timeline_blocked_equals_plain(spark):
    """The hot-symbol form (minute pieces + row blocks) equals the plain form."""
    from marketlens.plans.common import load_trades
    from conftest import SF001
    t = load_trades(spark, SF001)
    cols = ["volume", "volatility", "rsi", "macd", "bollinger_upper", "prev_price", "prev_rsi"]
    a = {r.event_id: r for r in al.state_timeline(t, block_rows=None).collect()}
    b = {r.event_id: r for r in al.state_timeline(t, block_rows=64).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in cols:
            x, y = a[k][c], b[k][c]
            assert (x is None) == (y is None), (k, c)
            if x is not None:
                assert x == pytest.approx(y, rel=1e-9, abs=1e-9), (k, c)
