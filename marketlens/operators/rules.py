"""Static rule alerts (R1-R8) and the notification outbox.

The reference substitutes numbers into the rule text and calls Python
``eval`` per row on the driver.  Here each rule's text is a Spark SQL
predicate evaluated with ``expr`` on the executors: every row yields an
array of (rule, fired) structs, filtered and exploded, so no row ever goes
through the driver.  A rule whose columns are absent from the input is
skipped (its text fails analysis); a NULL operand never fires.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.signals import severity_style

# The reference's rule set (name, condition, message, severity, channels).
DEFAULT_RULES = [
    {"rule_name": "high_volatility", "condition": "volatility > 0.05",
     "message": "Forte volatilité détectée", "severity": "HIGH",
     "channels": ["kafka", "email"]},
    {"rule_name": "rsi_oversold", "condition": "rsi < 30",
     "message": "Situation de survente (RSI < 30)", "severity": "MEDIUM",
     "channels": ["kafka", "slack"]},
    {"rule_name": "rsi_overbought", "condition": "rsi > 70",
     "message": "Situation de surachat (RSI > 70)", "severity": "MEDIUM",
     "channels": ["kafka", "slack"]},
    {"rule_name": "price_breakout", "condition": "price > upper_band OR price < lower_band",
     "message": "Cassure des bandes de Bollinger", "severity": "HIGH",
     "channels": ["kafka", "email", "slack"]},
    {"rule_name": "macd_signal",
     "condition": "macd_line > signal_line AND prev_macd_line <= prev_signal_line",
     "message": "Signal d'achat MACD détecté", "severity": "MEDIUM",
     "channels": ["kafka"]},
    {"rule_name": "volume_spike", "condition": "trade_count > avg_trade_count * 3",
     "message": "Pic de volume anormal", "severity": "HIGH",
     "channels": ["kafka", "email"]},
]

# Alert topic and mail addresses of the reference.
ALERT_TOPIC = "binance-alerts"
MAIL_FROM = "trading-bot@example.com"
MAIL_TO = "trader@example.com"


_SQL_WORDS = {"and", "or", "not", "null", "is", "true", "false", "between", "in", "like"}


def rule_columns(condition: str) -> set[str]:
    """Column names a rule's condition refers to (identifiers that are not
    SQL words or numbers)."""
    names = re.findall(r"[A-Za-z_][A-Za-z0-9_]*", condition)
    return {n for n in names if n.lower() not in _SQL_WORDS}


def applicable_rules(df: DataFrame, rules=None) -> list[dict]:
    """Rules whose columns all exist in ``df`` (a rule naming an absent
    column is skipped, as the reference's substitution leaves it unparsable)."""
    have = set(df.columns)
    return [r for r in (rules if rules is not None else DEFAULT_RULES)
            if rule_columns(r["condition"]) <= have]


def evaluate_rules(df: DataFrame, rules=None, timestamp: Column | None = None,
                   symbol_col: str = "symbol") -> DataFrame:
    """R7 + R8: one alert row per (input row, firing rule):
    ``rule_name, symbol, message, severity, timestamp, data, channels``.

    ``data`` is the whole input row as JSON; ``timestamp`` defaults to
    ``current_timestamp()`` (the reference uses the evaluation time).
    """
    rules = applicable_rules(df, rules)
    data_cols = df.columns
    ts = timestamp if timestamp is not None else F.current_timestamp()
    if not rules:
        empty = F.array().cast("array<struct<rule_name:string,message:string,severity:string,"
                               "channels:array<string>,fired:boolean>>")
        checks = empty
    else:
        checks = F.array(*[F.struct(F.lit(r["rule_name"]).alias("rule_name"),
                                    F.lit(r["message"]).alias("message"),
                                    F.lit(r["severity"]).alias("severity"),
                                    F.array(*[F.lit(c) for c in r["channels"]]).alias("channels"),
                                    F.coalesce(F.expr(r["condition"]), F.lit(False)).alias("fired"))
                           for r in rules])
    fired = F.filter(checks, lambda x: x["fired"])
    # rows without a firing rule go before anything is built from them
    hits = df.withColumn("_rules_fired", fired).filter(F.size("_rules_fired") > 0).select("*", F.explode("_rules_fired").alias("_rule"))
    own = ("rule_name", "symbol", "message", "severity", "timestamp", "data", "channels")
    return hits.select(F.col("_rule.rule_name").alias("rule_name"), F.col(symbol_col).alias("symbol"),
                       F.col("_rule.message").alias("message"), F.col("_rule.severity").alias("severity"),
                       ts.alias("timestamp"), F.to_json(F.struct(*[F.col(c) for c in data_cols])).alias("data"),
                       F.col("_rule.channels").alias("channels"),
                       *[F.col(c) for c in data_cols if c not in own])


# Wording of the mail and chat notices; it must read as it always did.
MAIL_SUBJECT = "Alerte %s - %s"
MAIL_BODY = "Alerte Trading - %s\n\nSymbole: %s\nMessage: %s\nTimestamp: %s\n\nDonnées: %s"
CHAT_FIELDS = [("Symbole", "symbol", True), ("Sévérité", "severity", True), ("Timestamp", "timestamp", False)]


def notification_outbox(alerts: DataFrame) -> DataFrame:
    """One row per (alert, channel) with what would be sent: the Kafka
    record (topic, key, JSON value), the mail subject/body, or the chat
    text, colour and attachment fields.  Delivery itself is outside Spark."""
    style = severity_style(F.col("severity"))
    ex = alerts.select("*", F.explode("channels").alias("channel"))
    subject = F.format_string(MAIL_SUBJECT, F.col("symbol"), F.col("severity"))
    fields = F.array(*[F.struct(F.lit(title).alias("title"), F.col(c).cast("string").alias("value"),
                                F.lit(short).alias("short")) for title, c, short in CHAT_FIELDS])
    body = F.format_string(MAIL_BODY, F.col("severity"), F.col("symbol"), F.col("message"),
                           F.col("timestamp").cast("string"), F.col("data"))
    kafka_value = F.to_json(F.struct("rule_name", "symbol", "message", "severity",
                                     F.col("timestamp").cast("string").alias("timestamp"),
                                     "data", "channels"))
    return ex.select(
        "*",
        F.when(F.col("channel") == "kafka", F.lit(ALERT_TOPIC)).alias("topic"),
        F.when(F.col("channel") == "kafka", F.col("symbol")).alias("key"),
        F.when(F.col("channel") == "kafka", kafka_value).alias("value"),
        F.when(F.col("channel") == "email", subject).alias("subject"),
        F.when(F.col("channel") == "email", body).alias("body"),
        F.when(F.col("channel") == "email", F.lit(MAIL_FROM)).alias("mail_from"),
        F.when(F.col("channel") == "email", F.lit(MAIL_TO)).alias("mail_to"),
        F.when(F.col("channel") == "slack", F.concat(F.lit("🚨 "), F.col("message"))).alias("text"),
        F.when(F.col("channel") == "slack", style["chat_color"]).alias("color"),
        F.when(F.col("channel") == "slack", fields).alias("fields"),
        style["panel_color"].alias("panel_color"), style["icon"].alias("icon"))
