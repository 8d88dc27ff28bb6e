"""Landed vendor payloads to typed records.

A payload frame has one row per vendor response:

    symbol / series_id / category   what was asked for
    interval                        bar series only; null means daily
    payload                         the response body, JSON text
    received_at                     when it landed (timestamp)

Every reader returns a *classified* frame: the record columns, `payload` (what to show for a
refused row) and `reason` (null for a good row). `operators.rejects` splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType, TimestampType

from tapewright import schemas
from tapewright.functions.checks import (
    first_reason,
    quote_reason,
    vendor_candle_reason,
    vendor_news_reason,
)
from tapewright.functions.numbers import above, to_double, to_long
from tapewright.functions.times import (
    epoch_seconds_or,
    in_market_hours,
    known_zones,
    local_to_utc,
    zone_or_default,
)

PAYLOADS = StructType(
    [
        StructField("symbol", StringType()),
        StructField("series_id", StringType()),
        StructField("category", StringType()),
        StructField("interval", StringType()),
        StructField("payload", StringType()),
        StructField("received_at", TimestampType()),
    ]
)

CANDLE_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume", "origin", "payload", "reason")
DEFAULT_NEWS_SOURCE = "Finnhub"  # fixed value: the vendor the news feed comes from
_ENTRY = StructType([StructField("key", StringType()), StructField("value", schemas.VENDOR_BAR)])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed envelopes: JSON lines, each holding the request fields and the response body."""
    return spark.read.schema(PAYLOADS).json(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Landed raw bodies: one file per response, below folders that name the request.

    For example `<path>/symbol=AAPL/interval=5min/0001.json`. The file's time is when it landed.
    """
    # The folder names are read as text; partition discovery would turn symbols like 0700 into numbers.
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    folder = F.col("_metadata.file_path")

    def requested(name: str) -> Column:
        value = F.regexp_extract(folder, f"/{name}=([^/]+)/", 1)
        return F.when(value != "", F.url_decode(value)).alias(name)

    return files.select(
        *(requested(name) for name in ("symbol", "series_id", "category", "interval")),
        F.col("value").alias("payload"),
        F.col("_metadata.file_modification_time").alias("received_at"),
    )


def stream_payloads(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAYLOADS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def quotes_to_candles(payloads: DataFrame, market_hours_only: bool = False) -> DataFrame:
    """One quote object per row to one candle; open, high and low fall back to the price.

    Previous close and the vendor's own change figures are carried along unused.
    """
    # inline() parses a payload once per row; filters on the fields stay above it.
    quotes = payloads.select("symbol", "payload", "received_at", F.inline(F.array(F.from_json("payload", schemas.QUOTE))))
    price = F.when(above(F.col("c"), 0), F.col("c"))

    def positive_or_price(field: str) -> Column:
        return F.coalesce(F.when(above(F.col(field), 0), F.col(field)), price)

    candles = quotes.select(
        "symbol",
        epoch_seconds_or(F.col("t"), F.col("received_at")).alias("ts"),
        positive_or_price("o").alias("open"),
        positive_or_price("h").alias("high"),
        positive_or_price("l").alias("low"),
        price.alias("close"),
        F.lit(0).cast("bigint").alias("volume"),
        F.lit("quote").alias("origin"),
        "t",
        schemas.CORRUPT,
        F.col("pc").alias("previous_close"),
        F.col("d").alias("vendor_change"),
        F.col("dp").alias("vendor_change_percent"),
        "payload",
    )
    if market_hours_only:
        candles = candles.where(in_market_hours(F.col("ts")))
    return candles.withColumn("reason", quote_reason()).drop("t", schemas.CORRUPT)


def news_items(payloads: DataFrame) -> DataFrame:
    """One array payload per row to one news record per element."""
    parsed = payloads.withColumn("items", F.from_json("payload", schemas.NEWS_ARRAY))
    # An unreadable body stays as one row, so that it is counted; an empty array yields none.
    broken = F.col("items").isNull()
    items = parsed.select(
        "category",
        "received_at",
        F.when(broken, F.col("payload")).alias("body"),
        F.explode(F.when(broken, F.array(F.lit(None).cast(schemas.NEWS_ITEM))).otherwise(F.col("items"))).alias("n"),
    )
    return (
        items.select(
            "body",
            "received_at",
            F.col("n.headline").alias("headline"),
            F.col("n.summary").alias("summary"),
            F.col("n.url").alias("url"),
            F.col("n.datetime").alias("datetime"),
            F.coalesce("n.category", "category").alias("category"),
            F.col("n.id").alias("vendor_id"),
            F.col("n.image").alias("image"),
            F.col("n.related").alias("related"),
            F.coalesce("n.source", F.lit(DEFAULT_NEWS_SOURCE)).alias("source"),
            F.coalesce("n.related", "category").alias("topic_key"),
            F.to_json("n").alias("item"),
        )
        .withColumn("reason", F.when(F.col("body").isNotNull(), "unreadable").otherwise(vendor_news_reason()))
        .select(
            "category",
            # A zero or negative time is still a time here; only a missing one falls back.
            F.when(F.col("reason").isNull(), F.coalesce(F.timestamp_seconds("datetime"), "received_at")).alias("datetime"),
            "headline",
            F.coalesce("vendor_id", F.unix_millis("received_at")).alias("id"),
            "image",
            "related",
            "source",
            "summary",
            "url",
            "topic_key",
            F.coalesce("body", "item").alias("payload"),
            "reason",
        )
    )


def series_observations(payloads: DataFrame) -> DataFrame:
    """Series responses to observation records, every observation of each."""
    exploded = payloads.withColumn("r", F.from_json("payload", schemas.SERIES)).select(
        "series_id",
        F.when(_broken("r") | (F.coalesce(F.size("r.observations"), F.lit(0)) < 1), F.col("payload")).alias("payload"),
        F.explode_outer("r.observations").alias("o"),
        _broken("r").alias("broken"),
    )
    return exploded.select(
        F.col("series_id").alias("seriesId"),
        F.col("o.date").alias("observationDate"),
        F.col("o.value").alias("value"),
        F.coalesce("o.realtime_start", F.lit("")).alias("realTimeStart"),
        F.coalesce("o.realtime_end", F.lit("")).alias("realTimeEnd"),
        F.coalesce("payload", F.to_json("o")).alias("payload"),
        first_reason(
            (F.col("broken"), "unreadable"),
            (F.col("o").isNull(), "no_observations"),
            (F.col("o.date").isNull(), "missing_date"),
            (F.col("o.value").isNull(), "missing_value"),
        ).alias("reason"),
    )


def _broken(envelope: str) -> Column:
    return F.col(envelope).isNull() | F.col(f"{envelope}.{schemas.CORRUPT}").isNotNull()


def _gate(envelope: str) -> Column:
    """Why a bar response carries no data: a call-limit note, a demo notice or any error."""
    note, info = F.col(f"`{envelope}`.`Note`"), F.col(f"`{envelope}`.`Information`")
    error = F.col(f"`{envelope}`.`Error Message`")
    return first_reason(
        (_broken(envelope), "unreadable"),
        (error.isNotNull(), "vendor_error"),
        (note.contains("API call frequency") | note.contains("Premium"), "call_limit_note"),
        (info.contains("demo API key") | info.contains("Thank you"), "vendor_notice"),
    )


def _bars(
    spark: SparkSession, responses: DataFrame, zone_field: str, pattern: str, origin: Column, missing: Column | None = None
) -> DataFrame:
    """Gate, explode the bar map and type the bars. `responses` has symbol, payload, r, bars; `missing` tells why there is no map."""
    zone = zone_or_default(F.col(f"r.`Meta Data`.`{zone_field}`"), known_zones(spark))
    none = F.when(F.col("bars").isNull(), "no_series")
    gate = F.coalesce(_gate("r"), none if missing is None else F.coalesce(missing, none))
    named = responses.select("symbol", "payload", "bars", gate.alias("gate"), zone.alias("zone"), origin.alias("origin"))
    # A good response's body is not carried beside each of its bars.
    gated = named.withColumn("payload", F.when(F.col("gate").isNotNull(), F.col("payload")))
    # A gated response yields one row without a bar; an ungated one yields its bars, maybe none.
    entries = F.when(
        F.col("gate").isNotNull(),
        F.array(F.lit(None).cast(_ENTRY)),
    ).otherwise(F.map_entries("bars"))
    exploded = gated.select("symbol", "payload", "gate", "zone", "origin", F.explode(entries).alias("e"))
    bar = "e.value."
    typed = {
        "ts": local_to_utc(F.col("e.key"), pattern, F.col("zone")),
        "open": to_double(F.col(bar + "`1. open`")),
        "high": to_double(F.col(bar + "`2. high`")),
        "low": to_double(F.col(bar + "`3. low`")),
        "close": to_double(F.col(bar + "`4. close`")),
        "volume": to_long(F.col(bar + "`5. volume`")),
    }
    shown = F.when(F.col("gate").isNotNull(), F.col("payload")).otherwise(F.to_json("e")).alias("payload")
    return (
        computed_once(exploded, typed, "symbol", "origin", shown, "gate")
        .withColumn("reason", F.coalesce("gate", vendor_candle_reason()))
        .select(*CANDLE_COLUMNS)
    )


def computed_once(df: DataFrame, columns: dict[str, Column], *keep: Column | str) -> DataFrame:
    """Add columns that later filters read many times, each computed once per row.

    Spark moves a filter below a projection by repeating the projected expressions in it. It does
    not move one below a generator.
    """
    row = F.struct(*(column.alias(name) for name, column in columns.items()))
    return df.select(*keep, F.inline(F.array(row)))


def daily_bars(payloads: DataFrame) -> DataFrame:
    """Daily bar maps keyed by date text, placed at midnight of the vendor's zone."""
    responses = payloads.withColumn("r", F.from_json("payload", schemas.DAILY_SERIES)).withColumn(
        "bars", F.col("r.`Time Series (Daily)`")
    )
    return _bars(payloads.sparkSession, responses, "5. Time Zone", "yyyy-MM-dd", F.lit("daily"))


def intraday_bars(payloads: DataFrame) -> DataFrame:
    """Intraday bar maps; the request's interval picks the map; an unknown interval is refused."""
    responses = payloads.withColumn("r", F.from_json("payload", schemas.INTRADAY_SERIES))
    bars = F.lit(None).cast(responses.schema["r"].dataType[f"Time Series ({schemas.INTERVALS[0]})"].dataType)
    for interval in reversed(schemas.INTERVALS):
        bars = F.when(F.col("interval") == interval, F.col(f"r.`Time Series ({interval})`")).otherwise(bars)
    return _bars(
        payloads.sparkSession,
        responses.withColumn("bars", bars),
        "6. Time Zone",
        "yyyy-MM-dd HH:mm:ss",
        F.concat(F.lit("intraday_"), F.col("interval")),
        F.when(F.col("interval").isNull() | ~F.col("interval").isin(*schemas.INTERVALS), "unknown_interval"),
    )


def merge_candles(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union of candle frames; `origin` tells where each came from."""
    merged = first.select(*CANDLE_COLUMNS)
    for frame in others:
        merged = merged.unionByName(frame.select(*CANDLE_COLUMNS))
    return merged
