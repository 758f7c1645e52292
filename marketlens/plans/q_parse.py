"""Registered queries: message parsing and normalisation.

Raw venue messages are built from ``events`` with ``to_json`` / string
functions (one message per event, the venue given by the trade mapping,
with malformed messages mixed in), parsed back by the library, and compared
with the plain projection of ``events`` the messages were built from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import normalize as nz
from marketlens.functions import parse as ps
from marketlens.operators.stats import window_stats
from marketlens.plans.common import TRADES_CTE, load_table, load_trades, r6
from marketlens.plans.registry import register
from marketlens.sources.tables import trades_from_events

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _epoch_ms(ts):
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), ts)


def _iso(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def envelope_messages(events):
    """Binance combined-stream envelopes: every 4th event is a mark price,
    every 19th a line that is not JSON."""
    mark = F.pmod("event_id", F.lit(4)) == 0
    stream = F.concat(F.lower("event_type"), F.when(mark, F.lit("@markPrice")).otherwise(F.lit("@aggTrade")))
    data = F.struct(F.upper("event_type").alias("s"), F.col("value").cast("string").alias("p"),
                    _epoch_ms(F.col("ts")).cast("string").alias("E"),
                    F.when(~mark, (F.pmod("event_id", F.lit(10)) + 1).cast("string")).alias("q"),
                    F.when(mark, F.lit("0.0001")).alias("r"))
    msg = F.to_json(F.struct(stream.alias("stream"), data.alias("data")))
    bad = F.pmod("event_id", F.lit(19)) == 0
    return events.select("event_id", F.when(bad, F.lit("not json")).otherwise(msg).alias("value"),
                         "ts")


_ENV_SQL_BASE = """e AS (SELECT *, event_id % 4 = 0 AS mark, event_id % 19 = 0 AS bad FROM events)"""


@register("parse_envelope", f"""
WITH {_ENV_SQL_BASE}
SELECT event_id, upper(event_type) AS symbol, value AS price,
       make_timestamp((epoch_us(ts) // 1000) * 1000) AS timestamp,
       CASE WHEN mark THEN 'mark' ELSE 'trade' END AS kind
FROM e WHERE NOT bad""")
def q_parse_envelope(spark, sf_dir):
    raw = envelope_messages(load_table(spark, sf_dir, "events"))
    env = ps.valid_envelope(ps.classify_stream(ps.parse_json_envelope(raw)))
    return env.select("event_id", F.col("data.s").alias("symbol"),
                      F.col("data.p").try_cast("double").alias("price"),
                      ps.epoch_ms_to_ts(F.col("data.E"), as_ntz=True).alias("timestamp"), "kind")


@register("parse_envelope_ticks", f"""
WITH {_ENV_SQL_BASE}
SELECT CASE WHEN NOT bad THEN upper(event_type) END AS symbol,
       CASE WHEN NOT bad THEN value END AS price,
       CASE WHEN NOT bad THEN make_timestamp((epoch_us(ts) // 1000) * 1000) END AS timestamp
FROM e""")
def q_parse_envelope_ticks(spark, sf_dir):
    raw = envelope_messages(load_table(spark, sf_dir, "events"))
    return ps.parse_envelope(raw, as_ntz=True)


@register("stats_from_envelopes_trades_only", f"""
WITH {_ENV_SQL_BASE},
t AS (SELECT upper(event_type) AS symbol, value AS price, make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts
      FROM e WHERE NOT bad AND NOT mark)
SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS window_start,
       time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
       round(avg(price), 6) AS avg_price, min(price) AS min_price, max(price) AS max_price,
       count(price) AS trade_count, round(stddev_samp(price), 6) AS volatility,
       round((max(price) - min(price)) / nullif(avg(price), 0) * 100, 6) AS trend
FROM t GROUP BY symbol, time_bucket(INTERVAL '1 hour', ts)""")
def q_stats_trades_only(spark, sf_dir):
    """A1 with ``source="trades"`` over parsed envelopes: mark prices dropped (Q8)."""
    raw = envelope_messages(load_table(spark, sf_dir, "events"))
    ticks = ps.parse_envelope(raw, as_ntz=True, keep_kind=True).withColumnRenamed("timestamp", "ts")
    return r6(window_stats(ticks, "1 hour", source="trades"), ["avg_price", "volatility", "trend"])


@register("mark_prices", f"""
WITH {_ENV_SQL_BASE}
SELECT upper(event_type) AS symbol, value AS mark_price, CAST('0.0001' AS DOUBLE) AS funding_rate
FROM e WHERE mark AND NOT bad""")
def q_mark_prices(spark, sf_dir):
    raw = envelope_messages(load_table(spark, sf_dir, "events"))
    m = ps.mark_prices(ps.parse_json_envelope(raw))
    return m.select("symbol", F.col("mark_price").cast("double").alias("mark_price"),
                    F.col("funding_rate").cast("double").alias("funding_rate"))


@register("trade_view", f"""
WITH {_ENV_SQL_BASE}
SELECT upper(event_type) AS symbol, value AS price,
       CASE WHEN mark THEN 0.0 ELSE CAST(event_id % 10 + 1 AS DOUBLE) END AS quantity,
       CAST((epoch_us(ts) // 1000) AS VARCHAR) AS timestamp
FROM e WHERE NOT bad""")
def q_trade_view(spark, sf_dir):
    raw = envelope_messages(load_table(spark, sf_dir, "events"))
    return ps.trade_view(ps.parse_json_envelope(raw))


# ---------------------------------------------------------------- venues

def venue_messages(events):
    """One raw message per event on its venue (user_id % 3), with
    malformed ones: Coinbase heartbeats (every 7th), Kraken objects (every
    13th), empty trade lists (every 17th) and two-element arrays (every 11th,
    pair 'unknown')."""
    t = trades_from_events(events).select("event_id", "exchange", "symbol", "price", "volume", "ts")
    sym = F.col("symbol")
    binance = F.to_json(F.struct(
        F.concat(F.lower(sym), F.lit("usdt@trade")).alias("stream"),
        F.struct(F.concat(sym, F.lit("USDT")).alias("s"), F.col("price").cast("string").alias("p"),
                 F.col("volume").cast("string").alias("q"), F.col("event_id").alias("t"),
                 _epoch_ms(F.col("ts")).alias("E")).alias("data")))
    cb_type = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("heartbeat")).otherwise(F.lit("match"))
    coinbase = F.to_json(F.struct(
        cb_type.alias("type"), F.concat(sym, F.lit("-USD")).alias("product_id"),
        F.col("price").cast("string").alias("price"), F.col("volume").cast("string").alias("size"),
        F.concat(_iso(F.col("ts")), F.lit("Z")).alias("time"), F.col("event_id").alias("trade_id")))
    pair = F.when(sym == "VIEW", F.lit("XBT/USD")).otherwise(F.concat(sym, F.lit("/USD")))
    trade = F.concat(F.lit('[["'), F.col("price").cast("string"), F.lit('","'),
                     F.col("volume").cast("string"), F.lit('","1700000000.0","b","l",""]]'))
    m = F.pmod("event_id", F.lit(17)) == 0
    trades_json = F.when(m, F.lit("[]")).otherwise(trade)
    kraken = (F.when(F.pmod("event_id", F.lit(13)) == 0, F.lit('{"event":"heartbeat"}'))
               .when(F.pmod("event_id", F.lit(11)) == 0,
                     F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(","), trades_json,
                              F.lit("]")))
               .otherwise(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(","),
                                   trades_json, F.lit(',"trade","'), pair, F.lit('"]'))))
    value = (F.when(F.col("exchange") == "binance", binance)
              .when(F.col("exchange") == "coinbase", coinbase).otherwise(kraken))
    return t.select("event_id", "exchange", value.alias("value"),
                    _iso(F.col("ts")).alias("ingest_time"))


def _normalized(spark, sf_dir):
    raw = venue_messages(load_table(spark, sf_dir, "events"))
    out = []
    for ex, fn in (("binance", ps.normalize_binance), ("coinbase", ps.normalize_coinbase),
                   ("kraken", ps.normalize_kraken)):
        out.append(fn(raw.filter(F.col("exchange") == ex)))
    return out


def _with_time(df):
    return df.select("exchange", "symbol", "price", "volume",
                     ps.parse_event_time("timestamp", as_ntz=True).alias("event_time"), "trade_id")


_V_SQL = f"""{TRADES_CTE},
b AS (SELECT 'binance' AS exchange, lower(symbol) || 'usdt' AS symbol, price, volume, ts AS event_time,
             CAST(event_id AS VARCHAR) AS trade_id FROM trades WHERE exchange = 'binance'),
c AS (SELECT 'coinbase' AS exchange, lower(symbol) || 'usd' AS symbol, price, volume, ts AS event_time,
             CAST(event_id AS VARCHAR) AS trade_id FROM trades
      WHERE exchange = 'coinbase' AND event_id % 7 <> 0),
k AS (SELECT 'kraken' AS exchange,
             CASE WHEN event_id % 11 = 0 THEN 'unknown'
                  WHEN symbol = 'VIEW' THEN 'btcusd' ELSE lower(symbol) || 'usd' END AS symbol,
             price, volume, ts AS event_time, CAST(NULL AS VARCHAR) AS trade_id FROM trades
      WHERE exchange = 'kraken' AND event_id % 13 <> 0 AND event_id % 17 <> 0)"""


@register("normalize_binance", f"WITH {_V_SQL}\nSELECT * FROM b")
def q_norm_binance(spark, sf_dir):
    return _with_time(_normalized(spark, sf_dir)[0])


@register("normalize_coinbase", f"WITH {_V_SQL}\nSELECT * FROM c")
def q_norm_coinbase(spark, sf_dir):
    return _with_time(_normalized(spark, sf_dir)[1])


@register("normalize_kraken", f"WITH {_V_SQL}\nSELECT * FROM k")
def q_norm_kraken(spark, sf_dir):
    return _with_time(_normalized(spark, sf_dir)[2])


@register("normalize_kraken_literal", f"""WITH {_V_SQL}
SELECT exchange, CASE WHEN symbol = 'unknown' THEN 'unknown'
                      WHEN symbol = 'btcusd' THEN 'xbt/usd'
                      ELSE regexp_replace(symbol, 'usd$', '/usd') END AS symbol,
       price, volume, event_time, trade_id FROM k""")
def q_norm_kraken_literal(spark, sf_dir):
    raw = venue_messages(load_table(spark, sf_dir, "events")).filter(F.col("exchange") == "kraken")
    return _with_time(ps.normalize_kraken(raw, canonical=False))


@register("unify_trades", f"""WITH {_V_SQL}
SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM k""")
def q_unify(spark, sf_dir):
    return _with_time(nz.unify_trades(*_normalized(spark, sf_dir)))


@register("fan_out_topics", f"""WITH {_V_SQL},
u AS (SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM k)
SELECT 'exchange-' || exchange AS topic, exchange, symbol, price, volume, trade_id FROM u
UNION ALL
SELECT 'all-exchanges', exchange, symbol, price, volume, trade_id FROM u""")
def q_fan_out(spark, sf_dir):
    from marketlens.streaming.sinks import fan_out_topics
    u = nz.unify_trades(*_normalized(spark, sf_dir))
    return fan_out_topics(u).select("topic", "exchange", "symbol", "price", "volume", "trade_id")


@register("parse_unified", f"""WITH {_V_SQL}
SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM k""")
def q_parse_unified(spark, sf_dir):
    from marketlens.streaming.sinks import fan_out_topics
    u = nz.unify_trades(*_normalized(spark, sf_dir))
    wire = fan_out_topics(u).filter(F.col("topic") == "all-exchanges").select("value")
    return _with_time(ps.parse_unified(wire, broker_ts=None))


@register("arbitrage_from_messages_1day", f"""WITH {_V_SQL},
u AS (SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM k),
p AS (SELECT *, regexp_replace(symbol, 'usdt?$', '') AS base FROM u
      WHERE symbol IN ('viewusdt', 'viewusd', 'btcusd', 'clickusdt', 'clickusd')),
v AS (SELECT time_bucket(INTERVAL '1 day', event_time) AS window_start, base, exchange,
             sum(price * volume) AS tv, sum(volume) AS vol, count(*) AS n
      FROM p GROUP BY ALL),
g AS (SELECT window_start, base, sum(n) AS n_trades, count(*) FILTER (WHERE vol > 0) AS n_venues FROM v GROUP BY ALL),
vv AS (SELECT *, tv / vol AS vwap FROM v WHERE vol > 0),
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start, base ORDER BY vwap, exchange) AS rn FROM vv) WHERE rn = 1),
ss AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start, base ORDER BY vwap DESC, exchange DESC) AS rn FROM vv) WHERE rn = 1)
SELECT g.base AS symbol, g.window_start, g.window_start + INTERVAL '1 day' AS window_end,
       bb.exchange AS buy_exchange, ss.exchange AS sell_exchange,
       round(bb.vwap, 6) AS buy_price, round(ss.vwap, 6) AS sell_price,
       round((ss.vwap - bb.vwap) / bb.vwap * 100, 6) AS arbitrage_percentage,
       round(least(bb.vol, ss.vol), 6) AS potential_volume,
       round((ss.vwap - bb.vwap) * least(bb.vol, ss.vol), 6) AS potential_profit_usd
FROM g JOIN bb USING (window_start, base) JOIN ss USING (window_start, base)
WHERE g.n_trades >= 2 AND g.n_venues >= 2 AND (ss.vwap - bb.vwap) / bb.vwap * 100 > 0.5""")
def q_arbitrage_messages(spark, sf_dir):
    """Messages -> P6-P9 -> P10 allow-list -> P11 suffix mode -> P12 -> A4-A7."""
    from marketlens.operators.arbitrage import arbitrage
    u = _with_time(nz.unify_trades(*_normalized(spark, sf_dir)))
    allow = ["viewusdt", "viewusd", "btcusd", "clickusdt", "clickusd"]
    out = arbitrage(u, "1 day", allow=allow, symbol_mode="suffix", ts_col="event_time")
    return r6(out, ["buy_price", "sell_price", "arbitrage_percentage", "potential_volume",
                    "potential_profit_usd"])


@register("symbol_normalisation", f"""
WITH s AS (SELECT event_id, lower(event_type) || CASE WHEN event_id % 2 = 0 THEN 'usdt' ELSE 'usd' END AS raw
           FROM events)
SELECT event_id, raw, regexp_replace(raw, 'usdt?$', '') AS base_suffix,
       regexp_replace(raw, '(usd|usdt)', '') AS base_literal,
       CASE WHEN instr(upper(raw), 'USDT') > 0
            THEN substr(upper(raw), 1, instr(upper(raw), 'USDT') - 1) || substr(upper(raw), instr(upper(raw), 'USDT') + 4)
            ELSE upper(raw) END AS coin,
       raw IN ('btcusdt', 'ethusd', 'ethusdt', 'btcusd') AS allowed
FROM s""")
def q_symbol_norm(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    raw = F.concat(F.lower("event_type"), F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit("usdt"))
                   .otherwise(F.lit("usd")))
    s = ev.select("event_id", raw.alias("raw"))
    return s.select("event_id", "raw", nz.normalize_symbol("raw", "suffix").alias("base_suffix"),
                    nz.normalize_symbol("raw", "literal").alias("base_literal"),
                    nz.coin_of(F.upper("raw")).alias("coin"),
                    F.col("raw").isin(nz.DEFAULT_SYMBOLS).alias("allowed"))


@register("stats_kv_roundtrip", f"""
WITH {TRADES_CTE},
s AS (SELECT symbol, time_bucket(INTERVAL '5 minutes', ts) AS window_start,
             avg(price) AS avg_price, min(price) AS min_price, max(price) AS max_price,
             count(price) AS trade_count, stddev_samp(price) AS volatility,
             (max(price) - min(price)) / nullif(avg(price), 0) * 100 AS trend
      FROM trades GROUP BY symbol, time_bucket(INTERVAL '5 minutes', ts))
SELECT symbol, round(avg_price, 6) AS avg_price, min_price, max_price, trade_count,
       round(coalesce(volatility, 0), 6) AS volatility, round(coalesce(trend, 0), 6) AS trend
FROM s""")
def q_stats_kv(spark, sf_dir):
    """P16 -> P15: statistics as key/value JSON, parsed back with zero
    defaults for fields ``to_json`` dropped (NULL volatility, Q9)."""
    from marketlens.schemas import STATS_MESSAGE
    kv = ps.stats_to_kv(window_stats(load_trades(spark, sf_dir), "5 minutes"))
    msg = kv.select(F.from_json("value", STATS_MESSAGE).alias("m")).select("m.*")
    return r6(nz.stats_view(msg), ["avg_price", "volatility", "trend"])


@register("parse_event_time_offsets", """
SELECT event_id, date_trunc('second', ts) - INTERVAL 2 HOUR AS east, date_trunc('second', ts) + INTERVAL 330 MINUTE AS west,
       date_trunc('second', ts) AS plain FROM events""")
def q_event_time_offsets(spark, sf_dir):
    """Text with offsets becomes UTC wall time."""
    text = F.replace(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    at = lambda suffix: ps.parse_event_time(F.concat(text, F.lit(suffix)), as_ntz=True)
    return load_table(spark, sf_dir, "events").select(
        "event_id", at("+02:00").alias("east"), at("-05:30").alias("west"), at("").alias("plain"))
