"""Registered queries: arbitrage."""

from __future__ import annotations

from marketlens.operators import arbitrage as ab
from marketlens.plans.common import LINEITEM_TRADES_CTE, TRADES_CTE, load_trades, r6
from marketlens.plans.registry import register

_FL = ["buy_price", "sell_price", "arbitrage_percentage", "potential_volume", "potential_profit_usd"]


def _bucket(width_sql):
    return f"time_bucket(INTERVAL '{width_sql}', ts, TIMESTAMP '1970-01-01')"


def _venues_cte(width_sql, src="trades"):
    return f"""v AS (
  SELECT {_bucket(width_sql)} AS window_start, {_bucket(width_sql)} + INTERVAL '{width_sql}' AS window_end,
         symbol, exchange, sum(price * volume) AS total_value, sum(volume) AS total_volume,
         count(*) AS trade_count,
         CASE WHEN sum(volume) > 0 THEN sum(price * volume) / sum(volume) END AS vwap
  FROM {src} WHERE price IS NOT NULL AND volume IS NOT NULL AND ts IS NOT NULL
  GROUP BY ALL)"""


def _arb_sql(width_sql, min_pct=0.5, src_cte=TRADES_CTE, src="trades", digits=6,
             min_notional=None):
    notional = (f" AND least(b.total_volume, s.total_volume) * b.vwap >= {min_notional}"
                if min_notional is not None else "")
    return f"""
WITH {src_cte},
{_venues_cte(width_sql, src)},
g AS (SELECT window_start, window_end, symbol, sum(trade_count) AS n_trades,
             count(vwap) AS n_venues FROM v GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start, symbol
                              ORDER BY vwap ASC, exchange ASC) AS rn FROM v WHERE vwap IS NOT NULL) WHERE rn = 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start, symbol
                              ORDER BY vwap DESC, exchange DESC) AS rn FROM v WHERE vwap IS NOT NULL) WHERE rn = 1)
SELECT g.symbol, g.window_start, g.window_end, b.exchange AS buy_exchange, s.exchange AS sell_exchange,
       round(b.vwap, {digits}) AS buy_price, round(s.vwap, {digits}) AS sell_price,
       round((s.vwap - b.vwap) / nullif(b.vwap, 0) * 100, {digits}) AS arbitrage_percentage,
       round(least(b.total_volume, s.total_volume), {digits}) AS potential_volume,
       round((s.vwap - b.vwap) * least(b.total_volume, s.total_volume), {digits}) AS potential_profit_usd
FROM g JOIN b ON g.window_start = b.window_start AND g.symbol = b.symbol
       JOIN s ON g.window_start = s.window_start AND g.symbol = s.symbol
WHERE g.n_trades >= 2 AND g.n_venues >= 2
  AND (s.vwap - b.vwap) / nullif(b.vwap, 0) * 100 > {min_pct}{notional}"""


def _arb_query(width, min_pct=0.5, source="events", digits=6, min_notional=None):
    def run(spark, sf_dir):
        t = load_trades(spark, sf_dir, source)
        return r6(ab.arbitrage(t, width, min_pct, min_notional=min_notional), _FL, digits)
    return run


for _name, _w in [("arbitrage_5s", "5 seconds"), ("arbitrage_1hour", "1 hour"),
                  ("arbitrage_1day", "1 day")]:
    register(_name, _arb_sql(_w))(_arb_query(_w))

register("arbitrage_1day_min_notional", _arb_sql("1 day", min_notional=1000))(
    _arb_query("1 day", min_notional=1000))
register("arbitrage_1day_pct5", _arb_sql("1 day", min_pct=5))(_arb_query("1 day", min_pct=5))
register("arbitrage_lineitem_365d",
         _arb_sql("365 days", src_cte=LINEITEM_TRADES_CTE, src="ltrades", digits=4))(
    _arb_query("365 days", source="lineitem", digits=4))


@register("venue_vwap_1day", f"""
WITH {TRADES_CTE},
{_venues_cte('1 day')}
SELECT window_start, window_end, symbol, exchange, round(total_value, 6) AS total_value,
       round(total_volume, 6) AS total_volume, trade_count, round(vwap, 6) AS vwap
FROM v WHERE vwap IS NOT NULL""")
def q_venue_vwap(spark, sf_dir):
    out = ab.venue_vwap(ab.prepare_trades(load_trades(spark, sf_dir)), "1 day")
    return r6(out, ["total_value", "total_volume", "vwap"])


@register("best_venues_1day", f"""
WITH {TRADES_CTE},
{_venues_cte('1 day')},
g AS (SELECT window_start, window_end, symbol, CAST(sum(trade_count) AS BIGINT) AS n_trades,
             count(vwap) AS n_venues FROM v GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start, symbol
                              ORDER BY vwap ASC, exchange ASC) AS rn FROM v WHERE vwap IS NOT NULL) WHERE rn = 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start, symbol
                              ORDER BY vwap DESC, exchange DESC) AS rn FROM v WHERE vwap IS NOT NULL) WHERE rn = 1)
SELECT g.window_start, g.window_end, g.symbol, b.exchange AS buy_exchange, round(b.vwap, 6) AS buy_price,
       round(b.total_volume, 6) AS buy_volume, s.exchange AS sell_exchange, round(s.vwap, 6) AS sell_price,
       round(s.total_volume, 6) AS sell_volume, g.n_trades, g.n_venues
FROM g JOIN b ON g.window_start = b.window_start AND g.symbol = b.symbol
       JOIN s ON g.window_start = s.window_start AND g.symbol = s.symbol
WHERE g.n_trades >= 2 AND g.n_venues >= 2""")
def q_best_venues(spark, sf_dir):
    out = ab.best_venues(ab.venue_totals(ab.prepare_trades(load_trades(spark, sf_dir)), "1 day"))
    return r6(out, ["buy_price", "buy_volume", "sell_price", "sell_volume"])


@register("window_trades_5min", f"""
WITH {TRADES_CTE}
SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start,
       time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end,
       symbol, exchange, price, volume, ts AS event_time
FROM trades WHERE price IS NOT NULL AND volume IS NOT NULL AND ts IS NOT NULL""")
def q_window_trades(spark, sf_dir):
    return ab.window_trades(ab.prepare_trades(load_trades(spark, sf_dir)), "5 minutes")


@register("arbitrage_1day_max_latency", _arb_sql("1 day").replace(
    "FROM trades WHERE price IS NOT NULL", "FROM trades WHERE event_id % 20 <= 10 AND price IS NOT NULL"))
def q_arbitrage_latency(spark, sf_dir):
    """The declared latency limit applied – broker time = event time +
    (event_id % 20) seconds, trades more than 10 s late are dropped first."""
    from pyspark.sql import functions as F
    t = load_trades(spark, sf_dir)
    t = t.withColumn("kafka_timestamp", F.timestamp_add(
        "SECOND", F.pmod("event_id", F.lit(20)), F.col("ts")))
    out = ab.arbitrage(t, "1 day", max_latency=ab.MAX_LATENCY_SECONDS)
    return r6(out, _FL)


@register("arbitrage_kv_roundtrip", _arb_sql("1 day"))
def q_arbitrage_kv(spark, sf_dir):
    """Opportunities as key/value JSON (detection time = window end
    here, for a deterministic record), parsed back."""
    from pyspark.sql import functions as F
    from marketlens.functions.parse import arbitrage_to_kv
    arb = ab.arbitrage(load_trades(spark, sf_dir), "1 day")
    kv = arbitrage_to_kv(arb, detection_time=F.col("window_end"))
    schema = ("symbol string, window_start timestamp_ntz, window_end timestamp_ntz, "
              "buy_exchange string, sell_exchange string, buy_price double, sell_price double, "
              "arbitrage_percentage double, potential_volume double, "
              "potential_profit_usd double, detection_time timestamp_ntz")
    back = kv.select(F.from_json("value", schema).alias("m")).select("m.*").drop("detection_time")
    return r6(back, _FL)
