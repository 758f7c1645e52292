"""Registered queries: serving."""

from __future__ import annotations

from marketlens.operators import serving as sv
from marketlens.operators.stats import window_stats
from marketlens.plans.common import TRADES_CTE, load_trades, r6, stats_cte
from marketlens.plans.registry import register

_STATS = ["avg_price", "volatility", "trend"]
_LATEST = f"""{stats_cte('5 minutes')},
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY window_end DESC, window_start DESC) AS rn
    FROM stats) WHERE rn = 1)"""
_RECENT = """recent AS (SELECT * FROM trades ORDER BY ts DESC, event_id DESC LIMIT {n})"""


def _inputs(spark, sf_dir):
    t = load_trades(spark, sf_dir)
    return t, window_stats(t, "5 minutes")


@register("latest_stats", f"""
WITH {TRADES_CTE},
{_LATEST}
SELECT symbol, window_start, window_end, round(avg_price, 6) AS avg_price, min_price, max_price,
       trade_count, round(volatility, 6) AS volatility, round(trend, 6) AS trend
FROM latest""")
def q_latest_stats(spark, sf_dir):
    t, s = _inputs(spark, sf_dir)
    return r6(sv.latest_stats(s), _STATS)


@register("latest_trade", f"""
WITH {TRADES_CTE}
SELECT event_id, symbol, exchange, price, volume, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS rn
  FROM trades) WHERE rn = 1""")
def q_latest_trade(spark, sf_dir):
    return sv.latest_trade(load_trades(spark, sf_dir))


@register("symbols", f"""
WITH {TRADES_CTE},
{stats_cte('5 minutes')}
SELECT symbol, count(*) OVER () AS symbol_count FROM (SELECT DISTINCT symbol FROM stats)""")
def q_symbols(spark, sf_dir):
    t, s = _inputs(spark, sf_dir)
    return sv.symbols(s)


@register("recent_trades", f"""
WITH {TRADES_CTE}
SELECT * FROM trades ORDER BY ts DESC, event_id DESC LIMIT 100""")
def q_recent_trades(spark, sf_dir):
    return sv.recent_trades(load_trades(spark, sf_dir), 100)


@register("recent_per_symbol", f"""
WITH {TRADES_CTE}
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS INTEGER) AS pos
  FROM trades) WHERE pos <= 50""")
def q_recent_per_symbol(spark, sf_dir):
    return sv.recent_per_symbol(load_trades(spark, sf_dir), 50)


@register("list_trades_a", f"""
WITH {TRADES_CTE},
buf AS (SELECT * FROM trades ORDER BY ts DESC, event_id DESC LIMIT 100),
lim AS (SELECT * FROM buf ORDER BY ts DESC, event_id DESC LIMIT 50)
SELECT * FROM lim WHERE symbol = 'VIEW'""")
def q_list_trades_a(spark, sf_dir):
    return sv.list_trades(load_trades(spark, sf_dir), 50, "VIEW", "A")


@register("list_trades_b", f"""
WITH {TRADES_CTE},
buf AS (SELECT * FROM trades ORDER BY ts DESC, event_id DESC LIMIT 100)
SELECT * FROM buf WHERE symbol = 'VIEW' ORDER BY ts DESC, event_id DESC LIMIT 50""")
def q_list_trades_b(spark, sf_dir):
    return sv.list_trades(load_trades(spark, sf_dir), 50, "VIEW", "B")


@register("list_stats", f"""
WITH {TRADES_CTE},
{_LATEST}
SELECT symbol, window_start, window_end, round(avg_price, 6) AS avg_price, min_price, max_price,
       trade_count, round(volatility, 6) AS volatility, round(trend, 6) AS trend
FROM latest WHERE symbol = 'CLICK'""")
def q_list_stats(spark, sf_dir):
    t, s = _inputs(spark, sf_dir)
    return r6(sv.list_stats(s, "CLICK"), _STATS)


@register("snapshot_trades", f"""
WITH {TRADES_CTE}
SELECT * FROM trades ORDER BY ts DESC, event_id DESC LIMIT 20""")
def q_snapshot(spark, sf_dir):
    t, s = _inputs(spark, sf_dir)
    trades, _ = sv.snapshot(t, s, 20)
    return trades


@register("snapshot_trades_10", f"""
WITH {TRADES_CTE}
SELECT * FROM trades ORDER BY ts DESC, event_id DESC LIMIT 10""")
def q_snapshot_10(spark, sf_dir):
    return sv.snapshot(*_inputs(spark, sf_dir), 10)[0]


@register("snapshot_stats", f"""
WITH {TRADES_CTE},
{_LATEST}
SELECT symbol, window_start, window_end, round(avg_price, 6) AS avg_price, min_price, max_price,
       trade_count, round(volatility, 6) AS volatility, round(trend, 6) AS trend FROM latest""")
def q_snapshot_stats(spark, sf_dir):
    return r6(sv.snapshot(*_inputs(spark, sf_dir), 10)[1], _STATS)


def _detail_sql(variant):
    recent = ("(SELECT * FROM (SELECT * FROM trades ORDER BY ts DESC, event_id DESC LIMIT 50) "
              "WHERE symbol = 'PURCHASE')" if variant == "A" else
              "(SELECT * FROM (SELECT * FROM trades ORDER BY ts DESC, event_id DESC LIMIT 100) "
              "WHERE symbol = 'PURCHASE' ORDER BY ts DESC, event_id DESC LIMIT 10)")
    found = ("l.window_end IS NOT NULL" if variant == "A"
             else "(l.window_end IS NOT NULL OR a.trades_count > 0)")
    return f"""
WITH {TRADES_CTE},
{_LATEST},
a AS (SELECT 'PURCHASE' AS symbol, count(*) AS trades_count,
             coalesce(avg(price), 0.0) AS recent_avg_price,
             coalesce(sum(volume), 0.0) AS total_volume FROM {recent} r)
SELECT a.symbol, l.window_start, l.window_end, round(l.avg_price, 6) AS avg_price, l.min_price,
       l.max_price, l.trade_count, round(l.volatility, 6) AS volatility, round(l.trend, 6) AS trend,
       a.trades_count, round(a.recent_avg_price, 6) AS recent_avg_price,
       round(a.total_volume, 6) AS total_volume
FROM a LEFT JOIN latest l ON a.symbol = l.symbol WHERE {found}"""


@register("symbol_detail_a", _detail_sql("A"))
def q_detail_a(spark, sf_dir):
    t, s = _inputs(spark, sf_dir)
    return r6(sv.symbol_detail(s, t, "PURCHASE", "A"), _STATS + ["recent_avg_price", "total_volume"])


@register("symbol_detail_b", _detail_sql("B"))
def q_detail_b(spark, sf_dir):
    t, s = _inputs(spark, sf_dir)
    return r6(sv.symbol_detail(s, t, "PURCHASE", "B"), _STATS + ["recent_avg_price", "total_volume"])


@register("symbol_trades_a", f"""
WITH {TRADES_CTE}
SELECT * FROM (SELECT * FROM trades ORDER BY ts DESC, event_id DESC LIMIT 50) WHERE symbol = 'PURCHASE'""")
def q_symbol_trades_a(spark, sf_dir):
    return sv.symbol_trades(load_trades(spark, sf_dir), "PURCHASE", "A")


@register("symbol_trades_b", f"""
WITH {TRADES_CTE}
SELECT * FROM (SELECT * FROM trades ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE symbol = 'PURCHASE'
ORDER BY ts DESC, event_id DESC LIMIT 10""")
def q_symbol_trades_b(spark, sf_dir):
    return sv.symbol_trades(load_trades(spark, sf_dir), "PURCHASE", "B")


@register("market_overview_a", f"""
WITH {TRADES_CTE},
{_LATEST},
{_RECENT.format(n=100)},
c AS (SELECT symbol, count(*) AS volume FROM recent GROUP BY symbol)
SELECT l.symbol, round(l.avg_price, 6) AS current_price, round(l.trend, 6) AS change_24h,
       round(l.volatility, 6) AS volatility, coalesce(c.volume, 0) AS volume,
       l.max_price AS high, l.min_price AS low
FROM latest l LEFT JOIN c ON l.symbol = c.symbol""")
def q_overview_a(spark, sf_dir):
    t, s = _inputs(spark, sf_dir)
    return r6(sv.market_overview(s, t, "A"), ["current_price", "change_24h", "volatility"])


@register("market_overview_b", f"""
WITH {TRADES_CTE},
{_LATEST}
SELECT symbol, round(avg_price, 6) AS current_price, round(trend, 6) AS change_24h,
       trade_count AS volume, round(volatility, 6) AS volatility,
       max_price AS high_24h, min_price AS low_24h, window_end AS last_update
FROM latest""")
def q_overview_b(spark, sf_dir):
    t, s = _inputs(spark, sf_dir)
    return r6(sv.market_overview(s, t, "B"), ["current_price", "change_24h", "volatility"])


_LAST50 = """last50 AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS pos
    FROM trades WHERE price <> 0) WHERE pos <= 50)"""


@register("live_stats", f"""
WITH {TRADES_CTE},
{_LAST50}
SELECT symbol, round(avg(price), 2) AS avg, round(min(price), 2) AS min, round(max(price), 2) AS max,
       round((max(price) - min(price)) / nullif(avg(price), 0) * 100, 2) AS volatility,
       count(*) AS count
FROM last50 GROUP BY symbol""")
def q_live_stats(spark, sf_dir):
    return sv.live_stats(load_trades(spark, sf_dir), 50)


@register("chart_bounds", f"""
WITH {TRADES_CTE},
{_LAST50}
SELECT symbol, round(min(price) * 0.9995, 6) AS suggested_min, round(max(price) * 1.0005, 6) AS suggested_max
FROM last50 GROUP BY symbol""")
def q_chart_bounds(spark, sf_dir):
    return r6(sv.chart_bounds(load_trades(spark, sf_dir), 50), ["suggested_min", "suggested_max"])


@register("health", f"""
WITH {TRADES_CTE},
{stats_cte('5 minutes')}
SELECT CAST(least(count(*), 100) AS BIGINT) AS buffered_trades,
       (SELECT count(DISTINCT symbol) FROM stats) AS symbols_with_stats,
       (SELECT 12 * count(DISTINCT symbol) FROM trades) AS active_alerts
FROM trades""")
def q_health(spark, sf_dir):
    from marketlens.plans.q_alerts import derive_alerts
    t, s = _inputs(spark, sf_dir)
    return sv.health(t, s, derive_alerts(t))
