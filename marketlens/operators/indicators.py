"""Technical indicators on ordered trades.

Reference semantics (kept on purpose):
* RSI: gain/loss are 0 on the first row; *simple* means over ``period+1``
  rows; RSI is NULL when the mean loss is 0.
* MACD: the "EMA"s are simple means over ``fast+1`` / ``slow+1`` rows; the
  signal is the mean of the MACD line over ``signal+1`` rows.
* Bollinger: mean +- k * sample stddev over ``period+1`` rows; position NULL
  for a zero-width band.
(``rowsBetween(-n, 0)`` holds n+1 rows.)

All frames share one partitioning and order, so one exchange + one sort feed
every Window node.  By default the partitioning is ``(symbol, _blk)`` of
``with_row_blocks`` (hot symbols split into blocks with a halo of the
preceding rows), which is exact for every frame here (at most 49 rows back).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.rounding import half_up

from marketlens.functions.normalize import coin_of
from marketlens.operators.frames import (DEFAULT_BLOCK_ROWS, DEFAULT_HALO, block_window, drop_blocks,
                                         with_row_blocks)

INDICATOR_COLUMNS = ["rsi", "macd_line", "signal_line", "macd_histogram",
                     "upper_band", "lower_band", "bb_position"]


def _frame(w, n_back: int, end: int = 0):
    return w.rowsBetween(-n_back, end)


def _blocks(t, keys, halo, block_rows):
    if "_pos" in t.columns:
        return t, False
    return with_row_blocks(t, keys=keys, halo=halo, block_rows=block_rows), True


def _finish(df, made):
    return drop_blocks(df) if made else df


def _indicator_cols(b: DataFrame, w, rsi_period=14, fast=12, slow=26, signal=9, bb_period=20,
                    bb_k=2.0, parts=("rsi", "macd", "bb")) -> DataFrame:
    """All indicator columns in four projections (one per dependency level:
    a window function cannot take another window function's output as its
    argument), so the plan stays shallow and cheap to analyse."""
    fr = lambda n: _frame(w, n)
    rsi_on, macd_on, bb_on = ("rsi" in parts), ("macd" in parts), ("bb" in parts)
    l1, l2, l3, l4 = {}, {}, {}, {}
    if rsi_on:
        l1["price_change"] = F.col("price") - F.lag("price").over(w)
        chg = F.col("price_change")
        # 0 on the first row: a NULL change falls to ``otherwise``
        l2["gain"] = F.when(chg > 0, chg).otherwise(F.lit(0.0))
        l2["loss"] = F.when(chg < 0, -chg).otherwise(F.lit(0.0))
        l3["avg_gain"] = F.avg("gain").over(fr(rsi_period))
        l3["avg_loss"] = F.avg("loss").over(fr(rsi_period))
        rs = F.try_divide(F.col("avg_gain"),
                          F.when(F.col("avg_loss") != 0, F.col("avg_loss")))
        l4["rs"] = rs
        l4["rsi"] = 100 - F.try_divide(F.lit(100.0), 1 + rs)
    if macd_on:
        l1["ema_fast"] = F.avg("price").over(fr(fast))
        l1["ema_slow"] = F.avg("price").over(fr(slow))
        l2["macd_line"] = F.col("ema_fast") - F.col("ema_slow")
        l3["signal_line"] = F.avg("macd_line").over(fr(signal))
        l4["macd_histogram"] = F.col("macd_line") - F.col("signal_line")
    if bb_on:
        l1["sma"] = F.avg("price").over(fr(bb_period))
        l1["price_std"] = F.stddev("price").over(fr(bb_period))
        l2["upper_band"] = F.col("sma") + F.col("price_std") * bb_k
        l2["lower_band"] = F.col("sma") - F.col("price_std") * bb_k
        width = F.col("upper_band") - F.col("lower_band")
        l3["bb_position"] = F.try_divide(F.col("price") - F.col("lower_band"),
                                         F.when(width != 0, width))
    for level in (l1, l2, l3, l4):
        if level:
            b = b.withColumns(level)
    return b


def price_change(t: DataFrame, keys=("symbol",), block_rows=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``price - lag(price)`` per symbol in ``(ts, event_id)`` order."""
    b, made = _blocks(t, keys, 1, block_rows)
    w = block_window(keys)
    return _finish(b.withColumn("price_change", F.col("price") - F.lag("price").over(w)), made)


def gain_loss(t: DataFrame, keys=("symbol",), block_rows=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """gain/loss split of the price change, 0 on the first row."""
    out = price_change(t, keys, block_rows)
    chg = F.col("price_change")
    return out.withColumns({"gain": F.when(chg > 0, chg).otherwise(F.lit(0.0)),
                            "loss": F.when(chg < 0, -chg).otherwise(F.lit(0.0))})


def rsi(t: DataFrame, period: int = 14, keys=("symbol",), block_rows=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """RSI with simple means over ``period+1`` rows (NULL when mean loss is 0)."""
    b, made = _blocks(t, keys, period + 1, block_rows)
    return _finish(_indicator_cols(b, block_window(keys), rsi_period=period, parts=("rsi",)), made)


def macd(t: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys=("symbol",),
         block_rows=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """MACD line, signal and histogram from simple means."""
    b, made = _blocks(t, keys, slow + signal, block_rows)
    return _finish(_indicator_cols(b, block_window(keys), fast=fast, slow=slow, signal=signal,
                                   parts=("macd",)), made)


def bollinger(t: DataFrame, period: int = 20, k: float = 2, keys=("symbol",),
              block_rows=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Bollinger bands (sample stddev) and band position."""
    b, made = _blocks(t, keys, period, block_rows)
    return _finish(_indicator_cols(b, block_window(keys), bb_period=period, bb_k=k,
                                   parts=("bb",)), made)


#: Rows that the default indicators of one row reach back, itself included:
#: the signal line's means of the slow means, and the change before them.
REACH = 26 + 9 + 1


def enrich(t: DataFrame, rsi_period: int = 14, fast: int = 12, slow: int = 26,
           signal: int = 9, bb_period: int = 20, bb_k: float = 2, keys=("symbol",),
           block_rows=DEFAULT_BLOCK_ROWS, extra: tuple = (), keep_blocks: bool = False) -> DataFrame:
    """RSI + MACD + Bollinger, projecting the reference's ten columns
    (plus ``event_id`` for identity and any ``extra`` input columns).
    ``keep_blocks`` returns the block columns (halo rows included) so that a
    caller can add more window columns on the same partitioning."""
    halo = max(rsi_period + 1, slow + signal, bb_period, 1) + 1
    b, made = _blocks(t, keys, halo, block_rows)
    b = _indicator_cols(b, block_window(keys), rsi_period, fast, slow, signal, bb_period, bb_k)
    keep = ["event_id", *keys, "price", "ts", *INDICATOR_COLUMNS, *extra]
    if made:
        keep += ["_pos", "_blk", "_halo"] if keep_blocks else ["_blk", "_halo"]
    out = b.select(*dict.fromkeys(keep))
    return out if (keep_blocks or not made) else _finish(out, made)


def with_prev_macd(df: DataFrame, keys=("symbol",), block_rows=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Previous MACD line and signal (inputs of the ``macd_signal`` rule)."""
    b = with_row_blocks(df, keys=keys, halo=1, block_rows=block_rows)
    w = block_window(keys)
    return drop_blocks(b.withColumns({"prev_macd_line": F.lag("macd_line").over(w),
                                      "prev_signal_line": F.lag("signal_line").over(w)}))


def enrich_for_rules(t: DataFrame, keys=("symbol",), block_rows=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """W6 + W12 in one blocked pass: indicators plus previous MACD/signal."""
    b, made = _blocks(t, keys, 26 + 9 + 2, block_rows)
    w = block_window(keys)
    b = _indicator_cols(b, w)
    b = b.withColumns({"prev_macd_line": F.lag("macd_line").over(w),
                       "prev_signal_line": F.lag("signal_line").over(w)})
    keep = ["event_id", *keys, "price", "ts", *INDICATOR_COLUMNS,
            "prev_macd_line", "prev_signal_line"]
    if made:
        keep += ["_blk", "_halo"]
    return _finish(b.select(*dict.fromkeys(keep)), made)


def _live_base(t: DataFrame, block_rows):
    """Dashboard history: non-zero prices keyed by coin."""
    t = t.filter(F.col("price").isNotNull() & (F.col("price") != 0)) \
         .withColumn("coin", coin_of(F.col("symbol")))
    return with_row_blocks(t, keys=["coin"], halo=DEFAULT_HALO, block_rows=block_rows)


def live_indicators(t: DataFrame, block_rows=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """The dashboard's indicators after each tick, over the coin's last
    <= 50 non-zero prices; all 0 while fewer than 14 ticks exist.

    * RSI: changes among the *oldest* 14 prices of the history; sums / 14;
      a zero loss divides by 1; rounded to 1.  With position p >= 50 those
      changes sit at rows p-48..p-36 (a 13-row frame); for 14 <= p < 50 they
      are the changes of rows 2..14, a running sum from the coin's first row
      (these rows are always in the coin's first block).  No 50-element
      arrays are built.
    * MACD: mean(last 12) - mean(last <= 26), rounded to 4.
    * Bollinger: last <= 20 prices, population stddev, +-2; rounded to 2.
    """
    b = _live_base(t, block_rows)
    w = block_window(["coin"])
    pos = F.col("_pos")
    b = b.withColumns({"_chg": F.col("price") - F.lag("price").over(w),
                       "_ema12": F.avg("price").over(w.rowsBetween(-11, 0)),
                       "_ema26": F.avg("price").over(w.rowsBetween(-25, 0)),
                       "_sma": F.avg("price").over(w.rowsBetween(-19, 0)),
                       "_sd": F.stddev_pop("price").over(w.rowsBetween(-19, 0))})
    chg = F.col("_chg")
    b = b.withColumns({"_g": F.when(chg > 0, chg).otherwise(F.lit(0.0)),
                       "_l": F.when(chg < 0, -chg).otherwise(F.lit(0.0))})
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    early = pos <= 14

    def oldest14(c):
        return F.when(pos >= 50, F.sum(c).over(w.rowsBetween(-48, -36))) \
                .otherwise(F.sum(F.when(early, F.col(c)).otherwise(F.lit(0.0))).over(running))
    b = b.withColumns({"_gains": oldest14("_g"), "_losses": oldest14("_l")})
    avg_gain = F.col("_gains") / 14
    avg_loss = F.col("_losses") / 14
    rs = avg_gain / F.when(avg_loss != 0, avg_loss).otherwise(F.lit(1.0))
    ready = pos >= 14
    zero = F.lit(0.0)
    out = b.select("event_id", "symbol", "coin", "price", "ts", "_blk", "_halo",
                   F.when(ready, half_up(100 - 100 / (1 + rs), 1)).otherwise(zero).alias("live_rsi"),
                   F.when(ready, half_up(F.col("_ema12") - F.col("_ema26"), 4)).otherwise(zero)
                    .alias("live_macd"),
                   F.when(ready, half_up(F.col("_sma") + 2 * F.col("_sd"), 2)).otherwise(zero)
                    .alias("bollinger_upper"),
                   F.when(ready, half_up(F.col("_sma"), 2)).otherwise(zero).alias("bollinger_middle"),
                   F.when(ready, half_up(F.col("_sma") - 2 * F.col("_sd"), 2)).otherwise(zero)
                    .alias("bollinger_lower"))
    return drop_blocks(out)


def tick_change(t: DataFrame, keys=("symbol",), block_rows=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """W10 + W11: change % vs the previous non-zero price (0 for the first
    tick), rounded to 2, and direction up / down / flat."""
    t = t.filter(F.col("price").isNotNull() & (F.col("price") != 0))
    b = with_row_blocks(t, keys=keys, halo=1, block_rows=block_rows)
    w = block_window(keys)
    prev = F.coalesce(F.lag("price").over(w), F.col("price"))
    b = b.withColumn("_prev", prev)
    out = b.withColumn("change_pct", half_up((F.col("price") - F.col("_prev")) / F.col("_prev") * 100, 2)) \
           .withColumn("direction", F.when(F.col("price") > F.col("_prev"), "up")
                                     .when(F.col("price") < F.col("_prev"), "down")
                                     .otherwise("flat"))
    return drop_blocks(out).drop("_prev")
