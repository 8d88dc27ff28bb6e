"""Every record, payload and table schema, written once."""

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


_S, _D, _L, _T = StringType(), DoubleType(), LongType(), TimestampType()

# ---- topics -----------------------------------------------------------------------------------
# The columns a Kafka source yields; topic folders written as Parquet carry the same ones.
CANDLE_TOPIC = "candles"
NEWS_TOPIC = "market-news"
OBSERVATION_TOPIC = "economic-observations"

# Typed records as they travel in a topic: (field, wire kind, nullable).
# Wire kinds: string, double, long, millis (long holding epoch milliseconds).
CANDLE_WIRE = (
    ("symbol", "string", False),
    ("open", "double", False),
    ("high", "double", False),
    ("low", "double", False),
    ("close", "double", False),
    ("volume", "long", False),
    ("timestamp", "millis", False),
)
NEWS_WIRE = (
    ("category", "string", False),
    ("datetime", "millis", False),
    ("headline", "string", False),
    ("id", "long", False),
    ("image", "string", True),
    ("related", "string", True),
    ("source", "string", False),
    ("summary", "string", False),
    ("url", "string", False),
)
OBSERVATION_WIRE = (
    ("seriesId", "string", False),
    ("observationDate", "string", False),
    ("value", "string", False),
    ("realTimeStart", "string", False),
    ("realTimeEnd", "string", False),
)

_WIRE_TYPES = {"string": _S, "double": _D, "long": _L, "millis": _T}


def record_type(wire) -> StructType:
    """The Spark struct for a wire record."""
    return _struct(*((name, _WIRE_TYPES[kind]) for name, kind, _ in wire))


def topic_rows(wire) -> StructType:
    """Rows of a topic folder."""
    return StructType(
        [
            StructField("key", _S), StructField("record", record_type(wire)), StructField("topic", _S), StructField("writer", _S),
            StructField("batch", _L), StructField("partition", IntegerType()), StructField("offset", _L), StructField("timestamp", _T),
        ]
    )


# ---- vendor payloads --------------------------------------------------------------------------
# CORRUPT is filled by the JSON reader with a body it could not take apart.
CORRUPT = "_corrupt_record"
QUOTE = _struct(
    ("c", _D), ("h", _D), ("l", _D), ("o", _D), ("pc", _D), ("t", _L), ("d", _D), ("dp", _D), (CORRUPT, _S)
)
NEWS_ITEM = _struct(
    ("category", _S),
    ("datetime", _L),
    ("headline", _S),
    ("id", _L),
    ("image", _S),
    ("related", _S),
    ("source", _S),
    ("summary", _S),
    ("url", _S),
)
NEWS_ARRAY = ArrayType(NEWS_ITEM)
SERIES = _struct(
    (
        "observations",
        ArrayType(_struct(("date", _S), ("value", _S), ("realtime_start", _S), ("realtime_end", _S))),
    ),
    (CORRUPT, _S),
)
VENDOR_BAR = _struct(
    ("1. open", _S), ("2. high", _S), ("3. low", _S), ("4. close", _S), ("5. volume", _S)
)
VENDOR_META = _struct(
    ("1. Information", _S),
    ("2. Symbol", _S),
    ("3. Last Refreshed", _S),
    ("4. Interval", _S),
    ("4. Output Size", _S),
    ("5. Output Size", _S),
    ("5. Time Zone", _S),
    ("6. Time Zone", _S),
)
_BARS = MapType(_S, VENDOR_BAR)
INTERVALS = ("1min", "5min", "15min", "30min", "60min")
_NOTES = (("Note", _S), ("Information", _S), ("Error Message", _S), (CORRUPT, _S))
DAILY_SERIES = _struct(("Meta Data", VENDOR_META), ("Time Series (Daily)", _BARS), *_NOTES)
INTRADAY_SERIES = _struct(
    ("Meta Data", VENDOR_META), *((f"Time Series ({i})", _BARS) for i in INTERVALS), *_NOTES
)

# ---- tables -----------------------------------------------------------------------------------
# `arrival` orders rewrites of one key: batch number in the high bits, source offset in the low.
CANDLES = _struct(
    ("symbol", _S),
    ("ts", _T),
    ("open", _D),
    ("high", _D),
    ("low", _D),
    ("close", _D),
    ("volume", _D),
    ("arrival", _L),
)
ROLLUPS = _struct(
    ("symbol", _S),
    ("ts", _T),
    ("n", _L),
    ("volatility_sum", _D),
    ("open", _D),
    ("open_ts", _T),
    ("high", _D),
    ("low", _D),
    ("close", _D),
    ("close_ts", _T),
    ("volume", _D),
    ("arrival", _L),
)
METRICS = _struct(
    ("symbol", _S),
    ("ts", _T),
    ("volatility", _D),
    ("risk_score", _D),
    ("price_change", _D),
    ("price_change_percent", _D),
    ("trend_numeric", _D),
    ("arrival", _L),
)
OBSERVATIONS = _struct(("series_id", _S), ("ts", _T), ("value", _D), ("arrival", _L))
NEWS = _struct(
    ("id", _S),
    ("ts", _T),
    ("headline", _S),
    ("summary", _S),
    ("sentiment", _S),
    ("source", _S),
    ("related_symbol", _S),
    ("arrival", _L),
)
REJECTS = _struct(
    ("source", _S), ("record_type", _S), ("reason", _S), ("rejected_at", _T), ("data", _S)
)
STOCK_SUMMARIES = _struct(
    ("symbol", _S),
    ("last_timestamp", _T),
    ("current_price", _D),
    ("latest_volume", _L),
    ("latest_volatility", _D),
    ("latest_risk_score", _D),
    ("latest_trend", _S),
    ("calculation_date", _S),
    ("price_change_today", _D),
    ("price_change_percent_today", _D),
    ("arrival", _L),
)
INDICATOR_SUMMARIES = _struct(
    ("indicator", _S),
    ("last_timestamp", _T),
    ("latest_value", _D),
    ("observation_date", _S),
    ("arrival", _L),
)
INDICATOR_METADATA = _struct(
    ("series_id", _S),
    ("title", _S),
    ("frequency", _S),
    ("units", _S),
    ("notes", _S),
    ("source", _S),
    ("last_updated", _T),
)
INSTRUMENTS = _struct(
    ("symbol", _S),
    ("name", _S),
    ("exchange", _S),
    ("currency", _S),
    ("sector", _S),
    ("industry", _S),
    ("description", _S),
    ("last_updated", _T),
)
REQUEST_LOG = _struct(("service", _S), ("ts", _T), ("ok", IntegerType()))

DAY = StructField("day", DateType(), True)
WRITER = StructField("writer", StringType(), True)
BATCH_ID = StructField("batch_id", LongType(), True)

# The dimension rows known in advance, as (series_id, title, frequency, units, source).
KNOWN_SERIES = (
    ("VIXCLS", "CBOE Volatility Index: VIX", "Daily", "Index", "Federal Reserve Economic Data"),
    ("SP500", "S&P 500", "Daily", "Index", "Federal Reserve Economic Data"),
    ("DGS10", "10-Year Treasury Constant Maturity Rate", "Daily", "Percent", "Federal Reserve Economic Data"),
    ("NASDAQCOM", "NASDAQ Composite Index", "Daily", "Index", "Federal Reserve Economic Data"),
    ("UNRATE", "Unemployment Rate", "Monthly", "Percent", "Federal Reserve Economic Data"),
    ("CPIAUCSL", "Consumer Price Index (All Urban Consumers)", "Monthly", "Index", "Federal Reserve Economic Data"),
)
