"""Symbol normalisation and venue merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The arbitrage allow-list of the reference job.
DEFAULT_SYMBOLS = ["btcusdt", "ethusd", "ethusdt", "btcusd"]


def filter_symbols(t: DataFrame, allow: list[str] | None = None,
                   col: str = "symbol") -> DataFrame:
    """P10: keep allow-listed symbols (an ``IN`` predicate: pushed into the
    Parquet scan in batch)."""
    return t.filter(F.col(col).isin(allow if allow is not None else DEFAULT_SYMBOLS))


def normalize_symbol(c, mode: str = "suffix") -> Column:
    """Symbol -> base asset by removing the quote currency.

    ``suffix`` (default) strips a trailing ``usd``/``usdt`` so that both
    venues meet (``btcusdt``, ``btcusd`` -> ``btc``); ``literal`` replays the
    reference pattern ``(usd|usdt)`` where the first alternative wins
    (``btcusdt`` -> ``btct``), Q1.
    """
    c = F.col(c) if isinstance(c, str) else c
    if mode == "suffix":
        return F.regexp_replace(c, "usdt?$", "")
    if mode == "literal":
        return F.regexp_replace(c, "(usd|usdt)", "")
    raise ValueError("mode must be 'suffix' or 'literal'")


def coin_of(c) -> Column:
    """Coin of a symbol: the first ``USDT`` removed (JS ``replace``)."""
    c = F.col(c) if isinstance(c, str) else c
    pos = F.instr(c, "USDT")
    return F.when(pos > 0, F.overlay(c, F.lit(""), pos, F.lit(4))).otherwise(c)


def stats_view(msg: DataFrame) -> DataFrame:
    """Statistics message -> typed view; *missing* (NULL) fields become 0
    (``dict.get(k, 0)``); present but non-numeric fields stay NULL."""
    def num(name, typ="double"):
        c = F.col(name)
        return F.when(c.isNull(), F.lit(0).cast(typ)).otherwise(c.try_cast(typ)).alias(name)
    return msg.select("symbol", num("avg_price"), num("min_price"), num("max_price"),
                      num("trade_count", "bigint"), num("volatility"), num("trend"))


def unify_trades(*venues: DataFrame) -> DataFrame:
    """Merge normalised venue streams into one (``unionByName``)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), venues)
