"""Message parsers (P1-P9, P12) and key/value encoders.

All parsers take a DataFrame with a ``value STRING`` column (a Kafka value
cast to string, or a line of a text file stream) and are permissive:
malformed JSON gives NULL structs, non-numeric numbers give NULL
(``try_cast``) and the row is dropped where the reference's parser would
have raised.  ``as_ntz=True`` produces event times as TIMESTAMP_NTZ (UTC
wall time), independent of the session time zone; streams keep TIMESTAMP,
which ``withWatermark`` requires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.schemas import COINBASE, ENVELOPE, UNIFIED

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms_to_ts(c, as_ntz: bool = False) -> Column:
    """Epoch-milliseconds text -> timestamp (NULL when not an integer)."""
    ms = _col(c).try_cast("bigint")
    if as_ntz:
        return F.when(ms.isNotNull(), F.timestamp_add("MILLISECOND", ms, F.expr(_EPOCH_NTZ)))
    return F.timestamp_millis(ms)


def parse_event_time(c, as_ntz: bool = False) -> Column:
    """ISO-8601 text -> timestamp, NULL when unparsable.  With
    ``as_ntz`` the wall time in UTC: an offset is applied, text without one is
    taken as it is."""
    c = _col(c)
    if as_ntz:
        zoned = c.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$") & c.contains(":")
        utc = F.timestamp_add("MICROSECOND", F.unix_micros(F.try_to_timestamp(c)), F.expr(_EPOCH_NTZ))
        return F.when(zoned, utc).otherwise(c.try_cast("timestamp_ntz"))
    return F.try_to_timestamp(c)


def parse_json_envelope(raw: DataFrame, value: str = "value") -> DataFrame:
    """Envelope ``{stream, data:{s,p,E,q,r,t}}`` -> columns ``stream, data``.

    The generator keeps filters on the result above the parsing: pushed below,
    they would each parse the message again."""
    return raw.select(F.inline(F.array(F.from_json(F.col(value), ENVELOPE))),
                      *[c for c in raw.columns if c != value])


def valid_envelope(env: DataFrame) -> DataFrame:
    """Keep messages having both ``stream`` and ``data``."""
    return env.filter(F.col("stream").isNotNull() & F.col("data").isNotNull())


def classify_stream(env: DataFrame) -> DataFrame:
    """``kind`` = trade (stream name contains aggTrade), mark (markPrice)
    or other."""
    s = F.col("stream")
    return env.withColumn("kind", F.when(s.contains("aggTrade"), "trade")
                                   .when(s.contains("markPrice"), "mark")
                                   .otherwise("other"))


def parse_envelope(raw: DataFrame, value: str = "value", as_ntz: bool = False,
                   keep_kind: bool = False) -> DataFrame:
    """Venue envelope -> ``(symbol, price, timestamp)`` ticks.

    Mark prices share the topic and the ``p`` field, so they are kept, as in
    the reference (Q8); ``keep_kind=True`` adds the P4 ``kind`` column so that
    ``window_stats(source="trades")`` can drop them.
    """
    env = classify_stream(parse_json_envelope(raw, value))
    cols = [F.col("data.s").alias("symbol"),
            F.col("data.p").try_cast("double").alias("price"),
            epoch_ms_to_ts(F.col("data.E"), as_ntz).alias("timestamp")]
    if keep_kind:
        cols.append(F.col("kind"))
    return env.select(*cols)


def mark_prices(env: DataFrame) -> DataFrame:
    """P5: mark-price projection: symbol (default UNKNOWN), mark price
    (default '0'), funding rate (default '0')."""
    e = env if "kind" in env.columns else classify_stream(env)
    return e.filter(F.col("kind") == "mark").select(
        F.coalesce(F.col("data.s"), F.lit("UNKNOWN")).alias("symbol"),
        F.coalesce(F.col("data.p"), F.lit("0")).alias("mark_price"),
        F.coalesce(F.col("data.r"), F.lit("0")).alias("funding_rate"))


def trade_view(env: DataFrame) -> DataFrame:
    """API trade projection; quantity 0 when absent (mark prices)."""
    e = env.filter(F.col("data").isNotNull())
    return e.select(F.col("data.s").alias("symbol"),
                    F.col("data.p").try_cast("double").alias("price"),
                    F.coalesce(F.col("data.q").try_cast("double"), F.lit(0.0)).alias("quantity"),
                    F.col("data.E").alias("timestamp")).filter(F.col("price").isNotNull())


def _num_or_zero(c: Column) -> Column:
    """``float(x or 0)``: missing -> 0, present but not numeric -> NULL."""
    return F.when(c.isNull(), F.lit(0.0)).otherwise(c.try_cast("double"))


def normalize_binance(raw: DataFrame, ingest_time: Column | None = None,
                      value: str = "value") -> DataFrame:
    """Binance message -> unified trade (needs ``data``)."""
    env = parse_json_envelope(raw, value).filter(F.col("data").isNotNull())
    ingest = ingest_time if ingest_time is not None else F.col("ingest_time")
    out = env.select(F.lit("binance").alias("exchange"),
                     F.lower(F.coalesce(F.col("data.s"), F.lit(""))).alias("symbol"),
                     _num_or_zero(F.col("data.p")).alias("price"),
                     _num_or_zero(F.col("data.q")).alias("volume"),
                     ingest.cast("string").alias("timestamp"),
                     F.col("data.t").alias("trade_id"))
    return out.filter(F.col("price").isNotNull() & F.col("volume").isNotNull())


def normalize_coinbase(raw: DataFrame, ingest_time: Column | None = None,
                       value: str = "value") -> DataFrame:
    """Coinbase ``match`` message -> unified trade; exchange time if
    present, else the ingest time."""
    m = raw.select(F.explode(F.array(F.from_json(F.col(value), COINBASE))).alias("m"), *[
        c for c in raw.columns if c != value])
    ingest = ingest_time if ingest_time is not None else F.col("ingest_time")
    out = m.filter(F.col("m.type") == "match").select(
        F.lit("coinbase").alias("exchange"),
        F.replace(F.lower(F.coalesce(F.col("m.product_id"), F.lit(""))), F.lit("-"), F.lit(""))
         .alias("symbol"),
        _num_or_zero(F.col("m.price")).alias("price"),
        _num_or_zero(F.col("m.size")).alias("volume"),
        F.coalesce(F.col("m.time"), ingest.cast("string")).alias("timestamp"),
        F.col("m.trade_id").alias("trade_id"))
    return out.filter(F.col("price").isNotNull() & F.col("volume").isNotNull())


def canonical_pair(pair: Column) -> Column:
    """Kraken pair -> venue-neutral symbol: ``xbt/usd`` -> ``btcusd`` (Q2)."""
    p = F.replace(F.lower(pair), F.lit("/"), F.lit(""))
    return F.regexp_replace(p, "^xbt", "btc")


def normalize_kraken(raw: DataFrame, ingest_time: Column | None = None,
                     canonical: bool = True, value: str = "value") -> DataFrame:
    """Kraken trade array -> unified trade.

    Needs a JSON array of length > 1 whose element 1 is a non-empty list;
    only its first trade is used; pair = last element when length > 2, else
    'unknown'.  ``canonical=False`` keeps the literal lower-cased pair.
    """
    arr = F.from_json(F.col(value), "array<string>")
    ingest = ingest_time if ingest_time is not None else F.col("ingest_time")
    a = raw.select(F.explode(F.array(arr)).alias("a"), ingest.cast("string").alias("_ingest"))
    trades = F.from_json(F.try_element_at(F.col("a"), F.lit(2)), "array<array<string>>")
    a = a.filter(F.col("a").isNotNull() & (F.size("a") > 1)).select("*", F.explode(F.array(trades)).alias("_tr"))
    a = a.filter(F.col("_tr").isNotNull() & (F.size("_tr") > 0))
    pair = F.when(F.size("a") > 2, F.try_element_at("a", F.lit(-1))).otherwise(F.lit("unknown"))
    first = F.try_element_at("_tr", F.lit(1))
    sym = canonical_pair(pair) if canonical else F.lower(pair)
    out = a.select(F.lit("kraken").alias("exchange"), sym.alias("symbol"),
                   F.try_element_at(first, F.lit(1)).try_cast("double").alias("price"),
                   F.try_element_at(first, F.lit(2)).try_cast("double").alias("volume"),
                   F.col("_ingest").alias("timestamp"),
                   F.lit(None).cast("string").alias("trade_id"))
    return out.filter(F.col("price").isNotNull() & F.col("volume").isNotNull())


def parse_unified(raw: DataFrame, value: str = "value",
                  broker_ts: str | None = "timestamp") -> DataFrame:
    """Merged-topic message -> unified trade columns (+ ``kafka_timestamp``)."""
    keep = [F.col(broker_ts).alias("kafka_timestamp")] if broker_ts and broker_ts in raw.columns else []
    return raw.select(F.from_json(F.col(value), UNIFIED).alias("d"), *keep) \
              .select("d.*", *[k for k in ["kafka_timestamp"] if keep])


def stats_to_kv(stats: DataFrame) -> DataFrame:
    """Statistics -> ``(key=symbol, value=JSON)``; NULL fields are omitted
    by ``to_json``."""
    return stats.select(F.col("symbol").alias("key"), F.to_json(F.struct(
        "symbol", "avg_price", "min_price", "max_price", "trade_count", "volatility",
        "trend", "window_start", "window_end")).alias("value"))


ARBITRAGE_FIELDS = ["buy_exchange", "sell_exchange", "buy_price", "sell_price",
                    "arbitrage_percentage", "potential_volume", "potential_profit_usd"]


def arbitrage_to_kv(arb: DataFrame, detection_time: Column | None = None) -> DataFrame:
    """Opportunity -> ``(key=symbol, value=JSON)`` with ``detection_time``
    (``current_timestamp()`` unless a column is given)."""
    dt = detection_time if detection_time is not None else F.current_timestamp()
    return arb.select(F.col("symbol").alias("key"), F.to_json(F.struct(
        "symbol", "window_start", "window_end", *ARBITRAGE_FIELDS,
        dt.alias("detection_time"))).alias("value"))
