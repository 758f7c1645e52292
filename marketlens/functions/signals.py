"""Classifiers and display rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.rounding import half_up

# Display digits per indicator family.
ROUND_DIGITS = {"rsi": 1, "macd": 4, "band": 2, "change": 2, "stats": 2}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rsi_signal(c) -> Column:
    """RSI > 70 overbought (sell), < 30 oversold (buy), else neutral."""
    c = _c(c)
    return F.when(c > 70, "overbought").when(c < 30, "oversold").otherwise("neutral")


def rsi_action(c) -> Column:
    c = _c(c)
    return F.when(c > 70, "sell").when(c < 30, "buy").otherwise("neutral")


def macd_signal(c, strict: bool = False) -> Column:
    """Bullish when MACD >= 0 (main view) or > 0 (``strict``, panel)."""
    c = _c(c)
    up = (c > 0) if strict else (c >= 0)
    return F.when(up, "bullish").otherwise("bearish")


def bb_signal(c) -> Column:
    """Band position > 0.8 overbought, < 0.2 oversold, else normal."""
    c = _c(c)
    return F.when(c > 0.8, "overbought").when(c < 0.2, "oversold").otherwise("normal")


# Severity styles (chat colour, panel colour, icon).
SEVERITY_COLORS = {"HIGH": "#ef4444", "MEDIUM": "#f97316"}
DEFAULT_SEVERITY_COLOR = "#64748b"
SEVERITY_ICONS = {"HIGH": "🚨", "MEDIUM": "⚠️"}
DEFAULT_SEVERITY_ICON = "ℹ️"


def severity_style(c) -> Column:
    """``struct(chat_color, panel_color, icon)`` for a severity."""
    c = _c(c)
    color = F.when(c == "HIGH", SEVERITY_COLORS["HIGH"]).when(
        c == "MEDIUM", SEVERITY_COLORS["MEDIUM"]).otherwise(DEFAULT_SEVERITY_COLOR)
    icon = F.when(c == "HIGH", SEVERITY_ICONS["HIGH"]).when(
        c == "MEDIUM", SEVERITY_ICONS["MEDIUM"]).otherwise(DEFAULT_SEVERITY_ICON)
    chat = F.when(c == "HIGH", "danger").otherwise("warning")
    return F.struct(chat.alias("chat_color"), color.alias("panel_color"), icon.alias("icon"))


def round_indicators(df: DataFrame) -> DataFrame:
    """Display rounding: RSI 1, MACD 4, bands 2, change 2, stats 2."""
    fam = {"rsi": "rsi", "live_rsi": "rsi", "macd_line": "macd", "signal_line": "macd",
           "macd_histogram": "macd", "macd": "macd", "live_macd": "macd",
           "upper_band": "band", "lower_band": "band", "bollinger_upper": "band",
           "bollinger_lower": "band", "bollinger_middle": "band", "change": "change",
           "change_pct": "change", "avg_price": "stats", "min_price": "stats",
           "max_price": "stats", "volatility": "stats", "trend": "stats"}
    return df.select(*[half_up(F.col(c), ROUND_DIGITS[fam[c]]).alias(c) if c in fam else F.col(c)
                       for c in df.columns])
