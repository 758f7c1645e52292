"""Registered queries: rule alerts (R1-R9, S9) and user alerts.

User alerts are not part of the driver tables, so the registered queries
derive an alert registry from the trades themselves: per symbol a fixed set
of condition templates whose thresholds come from the symbol's mean price,
plus one cross-symbol alert per symbol (paired with the symbol of highest
mean price) – the registry and the state timeline both grow with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions.rounding import half_up
from marketlens.operators import alerts as al
from marketlens.operators import indicators as ind
from marketlens.operators import rules as ru
from marketlens.operators.stats import window_stats, with_volume_baseline
from marketlens.plans.common import TRADES_CTE, load_trades, r6
from marketlens.plans.q_indicators import _ind_cte, _W
from marketlens.plans.registry import register
from marketlens.schemas import CONDITION
from marketlens.session import scratch_dir

# ------------------------------------------------------------------ rules

_RULE_IND = ["rsi", "macd_line", "signal_line", "upper_band", "lower_band", "price",
             "prev_macd_line", "prev_signal_line"]


def _rules_on_indicators(spark, sf_dir):
    e = ind.enrich_for_rules(load_trades(spark, sf_dir))
    e = r6(e, [c for c in _RULE_IND if c != "price"])
    a = ru.evaluate_rules(e, timestamp=F.col("ts"))
    return a.select("rule_name", "symbol", "event_id", "message", "severity", "timestamp",
                    F.array_join("channels", ",").alias("channels"))


_RULE_SQL_IND = f"""
WITH {_ind_cte()},
r AS (SELECT event_id, symbol, ts, price,
             round(rsi, 6) AS rsi, round(macd_line, 6) AS macd_line, round(signal_line, 6) AS signal_line,
             round(upper_band, 6) AS upper_band, round(lower_band, 6) AS lower_band,
             round(lag(macd_line) OVER ({_W}), 6) AS prev_macd_line,
             round(lag(signal_line) OVER ({_W}), 6) AS prev_signal_line FROM e)
SELECT 'rsi_oversold' AS rule_name, symbol, event_id, 'Situation de survente (RSI < 30)' AS message,
       'MEDIUM' AS severity, ts AS timestamp, 'kafka,slack' AS channels FROM r WHERE rsi < 30
UNION ALL
SELECT 'rsi_overbought', symbol, event_id, 'Situation de surachat (RSI > 70)', 'MEDIUM', ts,
       'kafka,slack' FROM r WHERE rsi > 70
UNION ALL
SELECT 'price_breakout', symbol, event_id, 'Cassure des bandes de Bollinger', 'HIGH', ts,
       'kafka,email,slack' FROM r WHERE price > upper_band OR price < lower_band
UNION ALL
SELECT 'macd_signal', symbol, event_id, 'Signal d''achat MACD détecté', 'MEDIUM', ts, 'kafka'
FROM r WHERE macd_line > signal_line AND prev_macd_line <= prev_signal_line"""

register("rules_on_indicators", _RULE_SQL_IND)(_rules_on_indicators)


def _stats_with_baseline(spark, sf_dir):
    s = with_volume_baseline(window_stats(load_trades(spark, sf_dir), "1 hour"))
    return r6(s, ["avg_price", "volatility", "trend", "avg_trade_count"])


_STATS_BASE_SQL = f"""{TRADES_CTE},
s0 AS (
  SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS window_start,
         count(price) AS trade_count, round(stddev_samp(price), 6) AS volatility
  FROM trades WHERE ts IS NOT NULL GROUP BY ALL),
s AS (SELECT *, round(avg(trade_count) OVER (PARTITION BY symbol ORDER BY window_start
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS avg_trade_count FROM s0)"""


@register("rules_on_stats", f"""
WITH {_STATS_BASE_SQL}
SELECT 'high_volatility' AS rule_name, symbol, window_start, 'HIGH' AS severity,
       'kafka,email' AS channels FROM s WHERE volatility > 0.05
UNION ALL
SELECT 'volume_spike', symbol, window_start, 'HIGH', 'kafka,email' FROM s
WHERE trade_count > avg_trade_count * 3""")
def q_rules_on_stats(spark, sf_dir):
    a = ru.evaluate_rules(_stats_with_baseline(spark, sf_dir), timestamp=F.col("window_end"))
    return a.select("rule_name", "symbol", "window_start", "severity",
                    F.array_join("channels", ",").alias("channels"))


@register("notification_outbox", f"""
WITH {_STATS_BASE_SQL},
a AS (
  SELECT 'high_volatility' AS rule_name, symbol, window_start, 'HIGH' AS severity,
         'Forte volatilité détectée' AS message, ['kafka', 'email'] AS channels FROM s WHERE volatility > 0.05
  UNION ALL
  SELECT 'volume_spike', symbol, window_start, 'HIGH', 'Pic de volume anormal', ['kafka', 'email']
  FROM s WHERE trade_count > avg_trade_count * 3),
x AS (SELECT *, unnest(channels) AS channel FROM a)
SELECT channel, rule_name, symbol, window_start, severity,
       CASE WHEN channel = 'kafka' THEN 'binance-alerts' END AS topic,
       CASE WHEN channel = 'kafka' THEN symbol END AS key,
       CASE WHEN channel = 'email' THEN 'Alerte ' || symbol || ' - ' || severity END AS subject,
       CASE WHEN channel = 'email' THEN 'trading-bot@example.com' END AS mail_from,
       CASE WHEN channel = 'email' THEN 'trader@example.com' END AS mail_to,
       CASE WHEN channel = 'slack' THEN '🚨 ' || message END AS text,
       CASE WHEN channel = 'slack' THEN CASE WHEN severity = 'HIGH' THEN 'danger' ELSE 'warning' END END AS color,
       CASE WHEN channel = 'slack' THEN '[{{"title":"Symbole","value":"' || symbol || '","short":true}},{{"title":"Sévérité","value":"' || severity
         || '","short":true}},{{"title":"Timestamp","value":"' || strftime(window_start + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') || '","short":false}}]' END AS fields,
       CASE WHEN severity = 'HIGH' THEN '🚨' WHEN severity = 'MEDIUM' THEN '⚠️' ELSE 'ℹ️' END AS icon,
       CASE WHEN severity = 'HIGH' THEN '#ef4444' WHEN severity = 'MEDIUM' THEN '#f97316' ELSE '#64748b' END AS panel_color
FROM x""")
def q_outbox(spark, sf_dir):
    s = _stats_with_baseline(spark, sf_dir)
    a = ru.evaluate_rules(s, timestamp=F.col("window_end"))
    o = ru.notification_outbox(a)
    return o.select("channel", "rule_name", "symbol", "window_start", "severity", "topic", "key",
                    "subject", "mail_from", "mail_to", "text", "color",
                    F.to_json("fields").alias("fields"), "icon", "panel_color")


# ------------------------------------------------------------------ user alerts

# Condition templates of the derived registry.  ``AVG`` is the
# symbol's mean price (2 decimals), ``TOP``/``TOPAVG`` the symbol of highest
# mean price and its mean.
ALERT_TEMPLATES = [
    ("above_avg", [("S", "price_above", "AVG")]),
    ("below_avg_low_rsi", [("S", "price_below", "AVG"), ("S", "rsi_below", "40")]),
    ("high_rsi_macd_up", [("S", "rsi_above", "60"), ("S", "macd_positive", "")]),
    ("busy_volatile", [("S", "volume_above", "2"), ("S", "volatility_above", "50")]),
    ("band_low_and_top", [("S", "bollinger_lower", ""), ("TOP", "price_above", "TOPAVG")]),
    ("band_high", [("S", "bollinger_upper", ""), ("S", "macd_negative", "")]),
    ("bad_threshold", [("S", "price_above", "abc")]),
    ("unknown_type", [("S", "price_sideways", "1")]),
    ("no_conditions", []),
    ("empty_threshold", [("S", "price_above", "")]),
    ("unknown_symbol", [("NOSUCH", "price_above", "1")]),
    ("volatility_below", [("S", "volatility_below", "10")]),
]


def derive_alerts(t):
    """Alert registry derived from trades (see module docstring)."""
    means = t.groupBy("symbol").agg(half_up(F.avg("price"), 2).alias("avg"))
    top = means.agg(F.max_by(F.struct("symbol", "avg"), F.struct("avg", "symbol")).alias("m"))
    top_sym = top.select("m.symbol").scalar()
    top_avg = top.select(F.col("m.avg").cast("string")).scalar()
    sub = {"S": F.col("symbol"), "TOP": top_sym, "AVG": F.col("avg").cast("string"),
           "TOPAVG": top_avg}
    rows = []
    for name, conds in ALERT_TEMPLATES:
        arr = F.array(*[F.struct(sub.get(s, F.lit(s)).alias("symbol"), F.lit(ty).alias("type"),
                                 sub.get(th, F.lit(th)).alias("threshold"))
                        for s, ty, th in conds]) if conds else \
            F.array().cast(f"array<{CONDITION.simpleString()}>")
        rows.append(F.struct(F.concat(F.col("symbol"), F.lit("_" + name)).alias("id"),
                             F.lit(name).alias("name"), arr.alias("conditions")))
    out = means.select(F.explode(F.array(*rows)).alias("a"), "symbol").select("a.*", "symbol")
    return out.select("id", "name", "conditions",
                      F.concat(F.lower("symbol"), F.lit("@example.com")).alias("email"),
                      F.lit("active").alias("status"), F.lit(False).alias("triggered"))


def _derived_alerts_sql():
    """DuckDB form of ``derive_alerts``: one row per (alert, condition)."""
    parts = []
    for name, conds in ALERT_TEMPLATES:
        if not conds:
            parts.append(f"SELECT symbol || '_{name}' AS id, '{name}' AS name, symbol, "
                         f"NULL::BIGINT AS cond_idx, NULL AS c_symbol, NULL AS c_type, NULL AS c_thr, 0 AS n FROM m")
            continue
        for i, (s, ty, th) in enumerate(conds):
            csym = {"S": "m.symbol", "TOP": "(SELECT symbol FROM top)"}.get(s, f"'{s}'")
            cthr = {"AVG": "CAST(m.avg AS VARCHAR)",
                    "TOPAVG": "(SELECT CAST(avg AS VARCHAR) FROM top)"}.get(th, f"'{th}'")
            parts.append(f"SELECT m.symbol || '_{name}' AS id, '{name}' AS name, m.symbol, "
                         f"{i}::BIGINT AS cond_idx, {csym} AS c_symbol, '{ty}' AS c_type, "
                         f"{cthr} AS c_thr, {len(conds)} AS n FROM m")
    return "\n  UNION ALL\n  ".join(parts)


_STATE_SQL = f"""{_ind_cte()},
m AS (SELECT symbol, round(avg(price), 2) AS avg FROM trades GROUP BY symbol),
top AS (SELECT symbol, avg FROM m ORDER BY avg DESC, symbol DESC LIMIT 1),
conds AS (
  {_derived_alerts_sql()}),
tl AS (
  SELECT symbol, ts, event_id, price,
         CAST(count(price) OVER (PARTITION BY symbol, time_bucket(INTERVAL '5 minutes', ts)
              ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS volume,
         stddev_samp(price) OVER (PARTITION BY symbol, time_bucket(INTERVAL '5 minutes', ts)
              ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS volatility,
         rsi, macd_line AS macd, upper_band AS bollinger_upper, lower_band AS bollinger_lower
  FROM e)"""

_MET_SQL = """CASE
    WHEN c_type IS NULL THEN TRUE
    WHEN st.symbol IS NULL THEN FALSE
    ELSE coalesce(CASE
      WHEN (c_thr IS NOT NULL AND c_thr <> '') AND TRY_CAST(c_thr AS DOUBLE) IS NULL
           AND c_type IN ('price_above','price_below','volatility_above','volume_above','rsi_above','rsi_below') THEN FALSE
      WHEN c_type = 'price_above' THEN st.price > coalesce(TRY_CAST(nullif(c_thr, '') AS DOUBLE), 0.0)
      WHEN c_type = 'price_below' THEN st.price < coalesce(TRY_CAST(nullif(c_thr, '') AS DOUBLE), 0.0)
      WHEN c_type = 'volatility_above' THEN st.volatility > coalesce(TRY_CAST(nullif(c_thr, '') AS DOUBLE), 0.0)
      WHEN c_type = 'volume_above' THEN st.volume > coalesce(TRY_CAST(nullif(c_thr, '') AS DOUBLE), 0.0)
      WHEN c_type = 'rsi_above' THEN st.rsi > coalesce(TRY_CAST(nullif(c_thr, '') AS DOUBLE), 0.0)
      WHEN c_type = 'rsi_below' THEN st.rsi < coalesce(TRY_CAST(nullif(c_thr, '') AS DOUBLE), 0.0)
      WHEN c_type = 'macd_positive' THEN st.macd > 0
      WHEN c_type = 'macd_negative' THEN st.macd < 0
      WHEN c_type = 'bollinger_upper' THEN st.price >= st.bollinger_upper * 0.99
      WHEN c_type = 'bollinger_lower' THEN st.price <= st.bollinger_lower * 1.01
      ELSE FALSE END, FALSE) END"""


BUCKET = "day"     # of first_trigger: the tables hold a few updates an hour


def _written(spark, df, name):
    """``df`` as a table below the shared checkpoint folder: read more than once, made once."""
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _timeline(spark, sf_dir):
    """The derived registry and the state timeline, both written."""
    t = load_trades(spark, sf_dir)
    return _written(spark, derive_alerts(t), "registry"), _written(spark, al.state_timeline(t), "timeline")


@register("evaluate_alerts", f"""
WITH {_STATE_SQL},
st AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS rn FROM tl) WHERE rn = 1),
j AS (SELECT conds.*, {_MET_SQL} AS met FROM conds LEFT JOIN st ON conds.c_symbol = st.symbol)
SELECT id, name, CAST(max(n) AS INTEGER) AS n_conditions, bool_and(met) AS fired FROM j GROUP BY id, name""")
def q_evaluate_alerts(spark, sf_dir):
    t = load_trades(spark, sf_dir)
    out = al.evaluate_alerts(derive_alerts(t), al.latest_state(t))
    return out.select("id", "name", "n_conditions", "fired")


_BELOW_SQL = """WHEN c_type = 'volatility_below' THEN st.volatility < coalesce(TRY_CAST(nullif(c_thr, '') AS DOUBLE), 0.0)
      ELSE FALSE END, FALSE) END"""


@register("evaluate_alerts_volatility_below", f"""
WITH {_STATE_SQL},
st AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS rn FROM tl) WHERE rn = 1),
j AS (SELECT conds.*, {_MET_SQL.replace('ELSE FALSE END, FALSE) END', _BELOW_SQL)} AS met FROM conds LEFT JOIN st ON conds.c_symbol = st.symbol)
SELECT id, name, CAST(max(n) AS INTEGER) AS n_conditions, bool_and(met) AS fired FROM j GROUP BY id, name""")
def q_evaluate_alerts_below(spark, sf_dir):
    """L2: the form's ``volatility_below`` switched on."""
    t = load_trades(spark, sf_dir)
    out = al.evaluate_alerts(derive_alerts(t), al.latest_state(t), volatility_below=True)
    return out.select("id", "name", "n_conditions", "fired")


@register("first_trigger", f"""
WITH {_STATE_SQL},
inst AS (SELECT DISTINCT ts, event_id FROM tl),
pairs AS (SELECT conds.*, inst.ts AS its, inst.event_id AS iev FROM conds, inst),
asof_state AS (
  SELECT p.*, st.* EXCLUDE (ts, event_id), st.ts AS sts
  FROM pairs p ASOF LEFT JOIN tl st ON p.c_symbol = st.symbol AND p.its >= st.ts),
metd AS (SELECT id, name, its, iev, n, {_MET_SQL.replace('st.symbol IS NULL', 'sts IS NULL').replace('st.', '')} AS met FROM asof_state),
held AS (SELECT id, name, its, iev FROM metd GROUP BY id, name, its, iev HAVING bool_and(met))
SELECT id, name, arg_min(its, its) AS trigger_ts, arg_min(iev, its) AS trigger_event_id
FROM held GROUP BY id, name""")
def q_first_trigger(spark, sf_dir):
    alerts, tl = _timeline(spark, sf_dir)
    out = al.first_trigger(alerts, tl, bucket=BUCKET)
    return out.select("id", "name", "trigger_ts", "trigger_event_id")


_FIRST_SQL = f"""{_STATE_SQL},
inst AS (SELECT DISTINCT ts, event_id FROM tl),
pairs AS (SELECT conds.*, inst.ts AS its, inst.event_id AS iev FROM conds, inst),
asof_state AS (
  SELECT p.*, st.* EXCLUDE (ts, event_id), st.ts AS sts
  FROM pairs p ASOF LEFT JOIN tl st ON p.c_symbol = st.symbol AND p.its >= st.ts),
metd AS (SELECT id, name, its, iev, n, {_MET_SQL.replace('st.symbol IS NULL', 'sts IS NULL').replace('st.', '')} AS met FROM asof_state),
held AS (SELECT id, name, its, iev FROM metd GROUP BY id, name, its, iev HAVING bool_and(met)),
fired AS (SELECT id, name, arg_min(its, its) AS trigger_ts, arg_min(iev, its) AS trigger_event_id
          FROM held GROUP BY id, name)"""


_MAIL_SQL = " || chr(10) || ".join(
    "'" + line.replace("'", "''").replace("%s", "' || {} || '") + "'" for line in al.MAIL_LINES).format(
        "f.name", "coalesce(txt.first_symbol, 'N/A')", "strftime(f.trigger_ts, '%d/%m/%Y %H:%M:%S')",
        "coalesce(txt.conditions_text, '')")


_ZERO_TL = "tl0 AS (SELECT symbol, ts, event_id, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in al.STATE_FIELDS) + " FROM tl),\ninst AS"


@register("first_trigger_zero_default", f"""
WITH {_FIRST_SQL.replace('inst AS', _ZERO_TL, 1).replace('tl st', 'tl0 st')}
SELECT id, name, trigger_ts, trigger_event_id FROM fired""")
def q_first_trigger_zero(spark, sf_dir):
    """L4 with missing state values read as 0."""
    alerts, tl = _timeline(spark, sf_dir)
    out = al.first_trigger(alerts, tl, zero_default=True, bucket=BUCKET)
    return out.select("id", "name", "trigger_ts", "trigger_event_id")


@register("trigger_notices", f"""
WITH {_FIRST_SQL},
txt AS (SELECT id, string_agg('  • ' || coalesce(c_symbol, 'N/A') || ': ' || replace(c_type, '_', ' ')
                              || ' ' || coalesce(c_thr, ''), chr(10) ORDER BY cond_idx) AS conditions_text,
               arg_min(c_symbol, cond_idx) AS first_symbol
        FROM conds GROUP BY id)
SELECT 'alert_triggered' AS type, f.id AS alert_id, f.name AS alert_name, 'triggered' AS status,
       lower(split_part(f.id, '_', 1)) || '@example.com' AS to_email,
       '🚨 Alerte Crypto: ' || f.name AS subject, coalesce(txt.first_symbol, 'N/A') AS symbol,
       coalesce(txt.conditions_text, '') AS conditions_text,
       {_MAIL_SQL} AS body
FROM fired f LEFT JOIN txt ON f.id = txt.id""")
def q_trigger_notices(spark, sf_dir):
    alerts, tl = _timeline(spark, sf_dir)
    return al.trigger_notices(al.first_trigger(alerts, tl, bucket=BUCKET), alerts)


@register("alert_status", f"""
WITH {_FIRST_SQL},
ids AS (SELECT DISTINCT id, name, lower(split_part(id, '_', 1)) || '@example.com' AS email FROM conds)
SELECT ids.id, ids.name, ids.email,
       CASE WHEN f.id IS NOT NULL THEN 'triggered' ELSE 'active' END AS status,
       f.id IS NOT NULL AS triggered
FROM ids LEFT JOIN fired f ON ids.id = f.id""")
def q_alert_status(spark, sf_dir):
    alerts, tl = _timeline(spark, sf_dir)
    return al.alert_status(alerts, al.first_trigger(alerts, tl, bucket=BUCKET))


_REG_SQL = f"""{TRADES_CTE},
m AS (SELECT symbol, round(avg(price), 2) AS avg FROM trades GROUP BY symbol),
top AS (SELECT symbol, avg FROM m ORDER BY avg DESC, symbol DESC LIMIT 1),
conds AS (
  {_derived_alerts_sql()})"""


@register("alert_registry_create", f"""
WITH {_REG_SQL},
base AS (SELECT count(DISTINCT id) AS n FROM conds),
new AS (SELECT * FROM conds WHERE symbol = 'VIEW'),
tpl AS (SELECT name, row_number() OVER () - 1 AS seq FROM (VALUES {", ".join(f"('{n}', {i})" for i, (n, _) in enumerate(ALERT_TEMPLATES))}) v(name, i) ORDER BY i),
valid AS (SELECT new.*, tpl.seq FROM new JOIN tpl USING (name)
          WHERE c_type IS NOT NULL AND (c_thr <> '' OR contains(c_type, 'macd_') OR contains(c_type, 'bollinger_'))),
created AS (SELECT 'copy_' || name || '_' || CAST((SELECT n FROM base) + row_number() OVER (ORDER BY seq) - 1 AS VARCHAR) AS id,
                   'copy_' || name AS name, count(*) AS n_conditions
            FROM valid GROUP BY name, seq)
SELECT id, name, n_conditions FROM created
UNION ALL
SELECT id, name, CAST(count(c_type) AS BIGINT) FROM conds GROUP BY id, name""")
def q_registry_create(spark, sf_dir):
    t = load_trades(spark, sf_dir)
    reg = derive_alerts(t)
    order = F.create_map(*[x for i, (n, _) in enumerate(ALERT_TEMPLATES)
                           for x in (F.lit(n), F.lit(i))])
    new = (reg.filter(F.col("id").startswith("VIEW_"))
              .select(F.concat(F.lit("copy_"), F.col("name")).alias("name"), "conditions", "email",
                      order[F.col("name")].alias("seq")))
    out = al.create_alerts(reg, new)
    return out.select("id", "name", F.size("conditions").cast("bigint").alias("n_conditions"))


@register("alert_registry_delete", f"""
WITH {_REG_SQL}
SELECT DISTINCT id, name FROM conds WHERE name <> 'bad_threshold'""")
def q_registry_delete(spark, sf_dir):
    reg = derive_alerts(load_trades(spark, sf_dir))
    gone = reg.filter(F.col("name") == "bad_threshold").select("id")
    return al.delete_alerts(reg, gone).select("id", "name")


_TL_W = "PARTITION BY symbol ORDER BY ts, event_id"


@register("state_timeline", f"""
WITH {_STATE_SQL}
SELECT symbol, ts, event_id, price, volume, round(volatility, 4) AS volatility,
       round(rsi, 6) AS rsi, round(macd, 6) AS macd,
       round(bollinger_upper, 6) AS bollinger_upper, round(bollinger_lower, 6) AS bollinger_lower,
       lag(price) OVER ({_TL_W}) AS prev_price, lag(volume) OVER ({_TL_W}) AS prev_volume,
       round(lag(rsi) OVER ({_TL_W}), 6) AS prev_rsi, round(lag(macd) OVER ({_TL_W}), 6) AS prev_macd
FROM tl""")
def q_state_timeline(spark, sf_dir):
    """L4's input: symbol state after (and before) each trade."""
    tl = al.state_timeline(load_trades(spark, sf_dir))
    out = tl.select("symbol", "ts", "event_id", "price", "volume", "volatility", "rsi", "macd",
                    "bollinger_upper", "bollinger_lower", "prev_price", "prev_volume",
                    "prev_rsi", "prev_macd")
    out = r6(out, ["rsi", "macd", "bollinger_upper", "bollinger_lower", "prev_rsi", "prev_macd"])
    # 4 digits: pieces merged pairwise differ from one running stddev in the last bits,
    # and the square root of a tiny variance magnifies that
    return r6(out, ["volatility"], 4)


@register("latest_state", f"""
WITH {_STATE_SQL},
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS rn
                      FROM tl) WHERE rn = 1)
SELECT symbol, price, volume, round(volatility, 4) AS volatility, round(rsi, 6) AS rsi,
       round(macd, 6) AS macd, round(bollinger_upper, 6) AS bollinger_upper,
       round(bollinger_lower, 6) AS bollinger_lower
FROM st""")
def q_latest_state(spark, sf_dir):
    """L3's input: state snapshot after each symbol's last trade (from its
    last 64 trades and latest statistics window only)."""
    st = al.latest_state(load_trades(spark, sf_dir))
    st = r6(st, ["rsi", "macd", "bollinger_upper", "bollinger_lower"])
    return r6(st, ["volatility"], 4)
