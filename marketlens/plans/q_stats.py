"""Registered queries: windowed statistics (A1, A2, W13, T3 sliding option)."""

from __future__ import annotations

from marketlens.operators.stats import window_stats, with_volume_baseline
from marketlens.plans.common import TRADES_CTE, load_trades, r6, stats_cte
from marketlens.plans.registry import register

_FLOATS = ["avg_price", "volatility", "trend"]
_SEL = """symbol, window_start, window_end, round(avg_price, 6) AS avg_price, min_price,
       max_price, trade_count, round(volatility, 6) AS volatility, round(trend, 6) AS trend"""


def _stats_query(width, width_sql):
    def run(spark, sf_dir):
        return r6(window_stats(load_trades(spark, sf_dir), width), _FLOATS)
    sql = f"WITH {TRADES_CTE},\n{stats_cte(width_sql)}\nSELECT {_SEL} FROM stats"
    return run, sql


for _name, _w, _ws in [("window_stats_5min", "5 minutes", "5 minutes"),
                       ("window_stats_1hour", "1 hour", "1 hour"),
                       ("window_stats_1day", "1 day", "1 day")]:
    _fn, _sql = _stats_query(_w, _ws)
    register(_name, _sql)(_fn)


@register("window_stats_sliding_1h_15min", f"""
WITH {TRADES_CTE},
k AS (SELECT unnest(generate_series(0, 3)) AS i),
exp AS (
  SELECT t.*, time_bucket(INTERVAL '15 minutes', ts) - i * INTERVAL '15 minutes' AS window_start
  FROM trades t, k WHERE ts IS NOT NULL)
SELECT symbol, window_start, window_start + INTERVAL '1 hour' AS window_end,
       round(avg(price), 6) AS avg_price, min(price) AS min_price, max(price) AS max_price,
       count(price) AS trade_count, round(stddev_samp(price), 6) AS volatility,
       round((max(price) - min(price)) / nullif(avg(price), 0) * 100, 6) AS trend
FROM exp GROUP BY symbol, window_start""")
def window_stats_sliding(spark, sf_dir):
    return r6(window_stats(load_trades(spark, sf_dir), "1 hour", "15 minutes"), _FLOATS)


@register("volume_baseline_1hour", f"""
WITH {TRADES_CTE},
{stats_cte('1 hour')}
SELECT symbol, window_start, trade_count,
       round(avg(trade_count) OVER (PARTITION BY symbol ORDER BY window_start
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS avg_trade_count
FROM stats""")
def volume_baseline(spark, sf_dir):
    s = with_volume_baseline(window_stats(load_trades(spark, sf_dir), "1 hour"))
    return r6(s.select("symbol", "window_start", "trade_count", "avg_trade_count"),
              ["avg_trade_count"])
