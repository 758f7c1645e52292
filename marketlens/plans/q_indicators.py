"""Registered queries: indicators and signals."""

from __future__ import annotations


from marketlens.functions.rounding import half_up

from pyspark.sql import functions as F

from marketlens.functions import signals as sg
from marketlens.operators import indicators as ind
from marketlens.plans.common import TRADES_CTE, load_trades, r6
from marketlens.plans.registry import register

_W = "PARTITION BY symbol ORDER BY ts, event_id"


def _rows(n, end="CURRENT ROW"):
    return f"OVER ({_W} ROWS BETWEEN {n} PRECEDING AND {end})"


def _ind_cte(rsi_period=14):
    return f"""{TRADES_CTE},
c AS (SELECT *, price - lag(price) OVER ({_W}) AS price_change FROM trades),
g AS (SELECT *, CASE WHEN price_change > 0 THEN price_change ELSE 0.0 END AS gain,
                CASE WHEN price_change < 0 THEN -price_change ELSE 0.0 END AS loss FROM c),
a AS (SELECT *, avg(gain) {_rows(rsi_period)} AS avg_gain, avg(loss) {_rows(rsi_period)} AS avg_loss,
                avg(price) {_rows(12)} AS ema_fast, avg(price) {_rows(26)} AS ema_slow,
                avg(price) {_rows(20)} AS sma, stddev_samp(price) {_rows(20)} AS price_std
      FROM g),
b AS (SELECT *, 100 - 100 / (1 + avg_gain / nullif(avg_loss, 0)) AS rsi,
                ema_fast - ema_slow AS macd_line,
                sma + price_std * 2 AS upper_band, sma - price_std * 2 AS lower_band FROM a),
d AS (SELECT *, avg(macd_line) {_rows(9)} AS signal_line,
                (price - lower_band) / nullif(upper_band - lower_band, 0) AS bb_position FROM b),
e AS (SELECT *, macd_line - signal_line AS macd_histogram FROM d)"""


def _round_sql(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@register("price_change", f"""
WITH {TRADES_CTE}
SELECT event_id, symbol, ts, price, round(price - lag(price) OVER ({_W}), 6) AS price_change
FROM trades""")
def q_price_change(spark, sf_dir):
    out = ind.price_change(load_trades(spark, sf_dir))
    return r6(out.select("event_id", "symbol", "ts", "price", "price_change"), ["price_change"])


@register("gain_loss", f"""
WITH {_ind_cte()}
SELECT event_id, symbol, round(gain, 6) AS gain, round(loss, 6) AS loss FROM g""")
def q_gain_loss(spark, sf_dir):
    out = ind.gain_loss(load_trades(spark, sf_dir))
    return r6(out.select("event_id", "symbol", "gain", "loss"), ["gain", "loss"])


def _rsi_query(period):
    def run(spark, sf_dir):
        out = ind.rsi(load_trades(spark, sf_dir), period)
        return r6(out.select("event_id", "symbol", "avg_gain", "avg_loss", "rsi"),
                  ["avg_gain", "avg_loss", "rsi"])
    sql = f"""
WITH {_ind_cte(period)}
SELECT event_id, symbol, {_round_sql(['avg_gain', 'avg_loss', 'rsi'])} FROM e"""
    return run, sql


for _p in (14, 20):
    _fn, _sql = _rsi_query(_p)
    register(f"rsi_{_p}", _sql)(_fn)


@register("macd", f"""
WITH {_ind_cte()}
SELECT event_id, symbol, {_round_sql(['macd_line', 'signal_line', 'macd_histogram'])} FROM e""")
def q_macd(spark, sf_dir):
    out = ind.macd(load_trades(spark, sf_dir))
    cols = ["macd_line", "signal_line", "macd_histogram"]
    return r6(out.select("event_id", "symbol", *cols), cols)


@register("bollinger", f"""
WITH {_ind_cte()}
SELECT event_id, symbol, {_round_sql(['upper_band', 'lower_band', 'bb_position'])} FROM e""")
def q_bollinger(spark, sf_dir):
    out = ind.bollinger(load_trades(spark, sf_dir))
    cols = ["upper_band", "lower_band", "bb_position"]
    return r6(out.select("event_id", "symbol", *cols), cols)


@register("enrich", f"""
WITH {_ind_cte()}
SELECT event_id, symbol, price, ts, {_round_sql(ind.INDICATOR_COLUMNS)} FROM e""")
def q_enrich(spark, sf_dir):
    return r6(ind.enrich(load_trades(spark, sf_dir)), ind.INDICATOR_COLUMNS)


@register("enrich_unblocked", f"""
WITH {_ind_cte()}
SELECT event_id, symbol, price, ts, {_round_sql(ind.INDICATOR_COLUMNS)} FROM e""")
def q_enrich_unblocked(spark, sf_dir):
    """W6 with one block per symbol (plain per-symbol window) – the plan to
    compare the blocked one against."""
    return r6(ind.enrich(load_trades(spark, sf_dir), block_rows=None), ind.INDICATOR_COLUMNS)


@register("enrich_small_blocks", f"""
WITH {_ind_cte()}
SELECT event_id, symbol, price, ts, {_round_sql(ind.INDICATOR_COLUMNS)} FROM e""")
def q_enrich_small_blocks(spark, sf_dir):
    """W6 with 500-row blocks: exercises the halo hand-over between blocks."""
    return r6(ind.enrich(load_trades(spark, sf_dir), block_rows=500), ind.INDICATOR_COLUMNS)


@register("prev_macd", f"""
WITH {_ind_cte()}
SELECT event_id, symbol, round(lag(macd_line) OVER ({_W}), 6) AS prev_macd_line,
       round(lag(signal_line) OVER ({_W}), 6) AS prev_signal_line FROM e""")
def q_prev_macd(spark, sf_dir):
    out = ind.with_prev_macd(ind.enrich(load_trades(spark, sf_dir)))
    return r6(out.select("event_id", "symbol", "prev_macd_line", "prev_signal_line"),
              ["prev_macd_line", "prev_signal_line"])


_LW = "PARTITION BY coin ORDER BY ts, event_id"


def _lrows(a, b="CURRENT ROW"):
    return f"OVER ({_LW} ROWS BETWEEN {a} PRECEDING AND {b})"


def _seq_sum(n):
    expr = "0.0"
    for k in range(n - 1, 0, -1):
        expr = f"({expr} + coalesce(lag(price, {k}) OVER ({_LW}), 0.0))"
    return f"{expr} + price"


@register("live_indicators", f"""
WITH {TRADES_CTE},
h AS (SELECT *, CASE WHEN instr(symbol, 'USDT') > 0
                     THEN substr(symbol, 1, instr(symbol, 'USDT') - 1) || substr(symbol, instr(symbol, 'USDT') + 4)
                     ELSE symbol END AS coin
      FROM trades WHERE price IS NOT NULL AND price <> 0),
p AS (SELECT *, row_number() OVER ({_LW}) AS pos, price - lag(price) OVER ({_LW}) AS chg FROM h),
q AS (SELECT *, CASE WHEN chg > 0 THEN chg ELSE 0.0 END AS g,
                CASE WHEN chg < 0 THEN -chg ELSE 0.0 END AS l FROM p),
s AS (SELECT *,
        CASE WHEN pos >= 50 THEN sum(g) {_lrows(48, '36 PRECEDING')}
             ELSE sum(CASE WHEN pos <= 14 THEN g ELSE 0.0 END) {_lrows(48)} END AS gains,
        CASE WHEN pos >= 50 THEN sum(l) {_lrows(48, '36 PRECEDING')}
             ELSE sum(CASE WHEN pos <= 14 THEN l ELSE 0.0 END) {_lrows(48)} END AS losses,
        avg(price) {_lrows(11)} AS ema12, avg(price) {_lrows(25)} AS ema26,
        -- the 20-row mean summed oldest first, as the dashboard's reduce does
        ({_seq_sum(20)}) / least(pos, 20) AS sma, stddev_pop(price) {_lrows(19)} AS sd
      FROM q)
SELECT event_id, symbol, coin, price, ts,
  CASE WHEN pos >= 14 THEN round(100 - 100 / (1 + (gains / 14) / (CASE WHEN losses / 14 <> 0 THEN losses / 14 ELSE 1.0 END)), 1) ELSE 0.0 END AS live_rsi,
  CASE WHEN pos >= 14 THEN round(ema12 - ema26, 4) ELSE 0.0 END AS live_macd,
  CASE WHEN pos >= 14 THEN round(sma + 2 * sd, 2) ELSE 0.0 END AS bollinger_upper,
  CASE WHEN pos >= 14 THEN round(sma, 2) ELSE 0.0 END AS bollinger_middle,
  CASE WHEN pos >= 14 THEN round(sma - 2 * sd, 2) ELSE 0.0 END AS bollinger_lower
FROM s""")
def q_live_indicators(spark, sf_dir):
    return ind.live_indicators(load_trades(spark, sf_dir))


@register("tick_change", f"""
WITH {TRADES_CTE},
p AS (SELECT *, coalesce(lag(price) OVER ({_W}), price) AS prev FROM trades
      WHERE price IS NOT NULL AND price <> 0)
SELECT event_id, symbol, price, ts, round((price - prev) / prev * 100, 2) AS change_pct,
       CASE WHEN price > prev THEN 'up' WHEN price < prev THEN 'down' ELSE 'flat' END AS direction
FROM p""")
def q_tick_change(spark, sf_dir):
    return ind.tick_change(load_trades(spark, sf_dir)).select(
        "event_id", "symbol", "price", "ts", "change_pct", "direction")


@register("indicator_signals", f"""
WITH {_ind_cte()},
r AS (SELECT event_id, symbol, {_round_sql(['rsi', 'macd_line', 'bb_position'])},
             round(rsi, 1) AS rsi_display, round(macd_line, 4) AS macd_display FROM e)
SELECT event_id, symbol,
       CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_class,
       CASE WHEN rsi > 70 THEN 'sell' WHEN rsi < 30 THEN 'buy' ELSE 'neutral' END AS rsi_action,
       CASE WHEN macd_line >= 0 THEN 'bullish' ELSE 'bearish' END AS macd_class,
       CASE WHEN macd_line > 0 THEN 'bullish' ELSE 'bearish' END AS macd_class_strict,
       CASE WHEN bb_position > 0.8 THEN 'overbought' WHEN bb_position < 0.2 THEN 'oversold' ELSE 'normal' END AS bb_class,
       rsi_display, macd_display
FROM r""")
def q_indicator_signals(spark, sf_dir):
    raw = ind.enrich(load_trades(spark, sf_dir))
    # the classes read the compared (6-digit) values, the display columns the shown ones
    e = sg.round_indicators(raw.select("event_id", "symbol", "rsi", "macd_line", *[
        half_up(c, 6).alias(c + "_6") for c in ("rsi", "macd_line", "bb_position")]))
    return e.select("event_id", "symbol",
                    sg.rsi_signal("rsi_6").alias("rsi_class"), sg.rsi_action("rsi_6").alias("rsi_action"),
                    sg.macd_signal("macd_line_6").alias("macd_class"),
                    sg.macd_signal("macd_line_6", strict=True).alias("macd_class_strict"),
                    sg.bb_signal("bb_position_6").alias("bb_class"),
                    F.col("rsi").alias("rsi_display"), F.col("macd_line").alias("macd_display"))
