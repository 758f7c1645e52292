"""Fixed message schemas (FIXTURES §1).  Numbers travel as JSON text in
string fields, which keeps their literal form (``from_json`` into a string
field returns the number's text)."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType,
                               StringType, StructField, StructType, TimestampType)

ENVELOPE_DATA = StructType([
    StructField("s", StringType()), StructField("p", StringType()),
    StructField("E", StringType()), StructField("q", StringType()),
    StructField("r", StringType()), StructField("t", StringType()),
])
ENVELOPE = StructType([StructField("stream", StringType()),
                       StructField("data", ENVELOPE_DATA)])

COINBASE = StructType([
    StructField("type", StringType()), StructField("product_id", StringType()),
    StructField("price", StringType()), StructField("size", StringType()),
    StructField("time", StringType()), StructField("trade_id", StringType()),
])

UNIFIED = StructType([
    StructField("exchange", StringType()), StructField("symbol", StringType()),
    StructField("price", DoubleType()), StructField("volume", DoubleType()),
    StructField("timestamp", StringType()), StructField("trade_id", StringType()),
])

STATS_MESSAGE = StructType([
    StructField("symbol", StringType()), StructField("avg_price", StringType()),
    StructField("min_price", StringType()), StructField("max_price", StringType()),
    StructField("trade_count", StringType()), StructField("volatility", StringType()),
    StructField("trend", StringType()), StructField("window_start", StringType()),
    StructField("window_end", StringType()),
])

CONDITION = StructType([StructField("symbol", StringType()), StructField("type", StringType()),
                        StructField("threshold", StringType())])
USER_ALERT = StructType([
    StructField("id", StringType()), StructField("name", StringType()),
    StructField("conditions", ArrayType(CONDITION)), StructField("email", StringType()),
    StructField("status", StringType()), StructField("triggered", BooleanType()),
])

RULE = StructType([StructField("rule_name", StringType()), StructField("condition", StringType()),
                   StructField("message", StringType()), StructField("severity", StringType()),
                   StructField("channels", ArrayType(StringType()))])

TRADE = StructType([StructField("event_id", LongType()), StructField("symbol", StringType()),
                    StructField("exchange", StringType()), StructField("price", DoubleType()),
                    StructField("volume", DoubleType()), StructField("ts", TimestampType())])
