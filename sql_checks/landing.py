"""Vendor payloads. Spark writes the tables' rows as vendor JSON, and the readers take them apart."""

from pyspark.sql import functions as F

from sql_checks import base
from sql_checks.base import check
from tapewright import schemas
from tapewright.operators.quality import quality_rate, valid_counts
from tapewright.operators.rejects import accepted, rejected
from tapewright.sources import landing

RECEIVED = "2024-01-31 00:00:00"


def _payloads(df, payload):
    return df.select(
        "symbol", payload.alias("payload"), F.lit(RECEIVED).cast("timestamp").alias("received_at")
    )


def quote_payloads(spark, folder):
    """Candles as quotes; some days lack a field, some break the range, some carry no price."""
    day, close = F.dayofmonth("ts"), F.col("close")
    quote = F.struct(
        F.when(day == 11, 0.0).otherwise(close).alias("c"),
        F.when(day == 5, 0.0).otherwise(F.col("high")).alias("h"),
        F.when(day == 13, close + 1).otherwise(F.col("low")).alias("l"),
        F.when(day != 7, F.col("open")).alias("o"),
        (close - 1).alias("pc"),
        F.lit(1.0).alias("d"),
        F.lit(0.5).alias("dp"),
        F.when(day != 3, F.unix_timestamp("ts")).alias("t"),
    )
    return _payloads(base.candles(spark, folder), F.to_json(quote))


_QUOTE = """
    SELECT symbol, CASE WHEN d = 3 THEN TIMESTAMP '2024-01-31' ELSE ts END AS ts,
      CASE WHEN d = 11 THEN NULL WHEN d <> 7 AND open > 0 THEN open ELSE close END AS open,
      CASE WHEN d <> 5 THEN high WHEN d <> 11 THEN close END AS high,
      CASE WHEN d = 13 THEN close + 1 ELSE low END AS low, CASE WHEN d <> 11 THEN close END AS close
    FROM (SELECT *, day(ts) AS d FROM candles)"""
_QUOTE_REASON = """CASE WHEN close IS NULL THEN 'no_price' WHEN high < low THEN 'high_below_low'
      WHEN high < close THEN 'high_below_close' WHEN low > close THEN 'low_above_close' END"""


@check(
    "quote_normalise",
    f" SELECT symbol, ts, open, high, low, close, 0::BIGINT AS volume FROM ({_QUOTE}) WHERE {_QUOTE_REASON} IS NULL",
    "candles",
)
def quote_normalise(spark, folder):
    good = accepted(landing.quotes_to_candles(quote_payloads(spark, folder)))
    return good.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


@check(
    "quote_rejects",
    f" SELECT reason, count(*) AS n FROM (SELECT {_QUOTE_REASON} AS reason FROM ({_QUOTE})) WHERE reason IS NOT NULL GROUP BY 1",
    "candles",
)
def quote_rejects(spark, folder):
    bad = rejected(landing.quotes_to_candles(quote_payloads(spark, folder)), "quotes", "quote", F.current_timestamp())
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _bar():
    def text(column):
        return F.col(column).cast("string")

    return F.struct(
        text("open").alias("1. open"),
        text("high").alias("2. high"),
        text("low").alias("3. low"),
        F.when(F.dayofmonth("ts") == 9, "abc").otherwise(text("close")).alias("4. close"),
        F.when(F.dayofmonth("ts") == 17, "x").otherwise(text("volume")).alias("5. volume"),
    )


def daily_payloads(spark, folder):
    """Each candle as a daily response; zones differ by day, one of them unknown."""
    day = F.dayofmonth("ts")
    zone = F.when(day <= 10, "UTC").when(day <= 20, "US/Eastern").otherwise("Nowhere/X")
    body = F.struct(
        F.struct(F.col("symbol").alias("2. Symbol"), zone.alias("5. Time Zone")).alias("Meta Data"),
        F.create_map(F.to_date("ts").cast("string"), _bar()).alias("Time Series (Daily)"),
    )
    noted = F.struct(F.lit("Our standard API call frequency is limited").alias("Note"))
    notice = F.struct(F.lit("Thank you for using the service").alias("Information"))
    text = F.when(day == 15, F.to_json(noted)).when(day == 16, F.to_json(notice)).otherwise(F.to_json(body))
    return _payloads(base.candles(spark, folder), text)


_DAILY = """
    SELECT symbol, CASE WHEN d <= 10 THEN ts ELSE ts + INTERVAL 5 HOURS END AS ts, open, high, low, close,
      CASE WHEN d = 17 THEN 0 ELSE volume END AS volume, CASE WHEN d = 15 THEN 'call_limit_note'
        WHEN d = 16 THEN 'vendor_notice' WHEN d = 9 THEN 'price_not_positive' END AS reason
    FROM (SELECT *, day(ts) AS d FROM candles)"""


@check(
    "vendor_candle_explode",
    f" SELECT symbol, ts, open, high, low, close, volume FROM ({_DAILY}) WHERE reason IS NULL",
    "candles",
)
def vendor_candle_explode(spark, folder):
    good = accepted(landing.daily_bars(daily_payloads(spark, folder)))
    return good.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


@check(
    "vendor_candle_rejects",
    f" SELECT reason, count(*) AS n FROM ({_DAILY}) WHERE reason IS NOT NULL GROUP BY 1",
    "candles",
)
def vendor_candle_rejects(spark, folder):
    bad = landing.daily_bars(daily_payloads(spark, folder)).where(F.col("reason").isNotNull())
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def intraday_payloads(spark, folder):
    """Events as one-bar intraday responses; the interval asked for follows the event type."""
    kind = F.col("event_type")
    interval = F.when(kind == "view", "1min").when(kind == "click", "15min").when(kind == "error", "60min").otherwise("5min")
    value = F.col("value").cast("string")
    bar = F.struct(
        value.alias("1. open"), value.alias("2. high"), value.alias("3. low"), value.alias("4. close"),
        F.col("event_id").cast("string").alias("5. volume"),
    )
    clock = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss")
    series = [F.when(interval == i, F.create_map(clock, bar)).alias(f"Time Series ({i})") for i in schemas.INTERVALS]
    zone = F.struct(F.lit("UTC").alias("6. Time Zone")).alias("Meta Data")
    return base.table(spark, folder, "events").select(
        base.symbol_of("user_id").alias("symbol"),
        # Purchases are asked for at an interval that does not exist and so are refused.
        F.when(kind == "purchase", "2min").otherwise(interval).alias("interval"),
        F.to_json(F.struct(zone, *series)).alias("payload"),
        F.lit(RECEIVED).cast("timestamp").alias("received_at"),
    )


@check(
    "vendor_intraday_explode",
    """
    SELECT printf('SYM%04d', user_id) AS symbol, date_trunc('second', ts) AS ts, value AS open,
      value AS high, value AS low, value AS close, event_id AS volume,
      concat('intraday_', CASE event_type WHEN 'view' THEN '1min' WHEN 'click' THEN '15min' WHEN 'error' THEN '60min' ELSE '5min' END) AS origin
    FROM events WHERE event_type <> 'purchase' AND value > 0""",
)
def vendor_intraday_explode(spark, folder):
    good = accepted(landing.intraday_bars(intraday_payloads(spark, folder)))
    return good.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", "origin")


_BAR_JSON = """'{"1. open":"' || v || '","2. high":"' || v || '","3. low":"' || v || '","4. close":"' || v || '","5. volume":"' || event_id || '"}'"""


@check(
    "intraday_rejects",
    f"""
    SELECT symbol, reason, CASE WHEN reason = 'unknown_interval'
        THEN '{{"Meta Data":{{"6. Time Zone":"UTC"}},"Time Series (5min)":{{"' || clock || '":' || bar || '}}}}'
        ELSE '{{"key":"' || clock || '","value":' || bar || '}}' END AS payload
    FROM (SELECT *, {_BAR_JSON} AS bar FROM (SELECT printf('SYM%04d', user_id) AS symbol, CAST(value AS VARCHAR) AS v, event_id,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS clock,
        CASE WHEN event_type = 'purchase' THEN 'unknown_interval' WHEN value <= 0 THEN 'price_not_positive' END AS reason FROM events))
    WHERE reason IS NOT NULL""",
)
def intraday_rejects(spark, folder):
    """Whole bodies of refused requests, and refused bars."""
    bars = landing.intraday_bars(intraday_payloads(spark, folder))
    return bars.where(F.col("reason").isNotNull()).select("symbol", "reason", "payload")


@check(
    "candle_union",
    f"""
    SELECT symbol, ts, close, volume, 'quote' AS origin FROM (SELECT *, 0::BIGINT AS volume FROM ({_QUOTE})) WHERE {_QUOTE_REASON} IS NULL
    UNION ALL SELECT symbol, ts, close, volume, 'daily' FROM ({_DAILY}) WHERE reason IS NULL""",
    "candles",
)
def candle_union(spark, folder):
    quotes = landing.quotes_to_candles(quote_payloads(spark, folder))
    daily = landing.daily_bars(daily_payloads(spark, folder))
    merged = accepted(landing.merge_candles(quotes, daily))
    return merged.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "volume", "origin")


def news_payloads(spark, folder):
    """Each document as a one-item array; the summary is the whole text."""
    item = F.struct(
        F.when(F.col("lang") != "de", F.col("lang")).alias("category"),
        F.unix_timestamp("ts").alias("datetime"),
        "headline",
        F.col("doc_id").alias("id"),
        F.col("related_symbol").alias("related"),
        F.col("source").alias("source"),
        F.col("summary").alias("summary"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("ftp://"), "source")).otherwise(F.col("url")).alias("url"),
    )
    return base.articles(spark, folder).select(
        F.lit("general").alias("category"),
        F.to_json(F.array(item)).alias("payload"),
        F.lit(RECEIVED).cast("timestamp").alias("received_at"),
    )


_NEWS_REASON = r"""
    SELECT coalesce(nullif(lang, 'de'), 'general') AS category, doc_id,
      CASE WHEN NOT regexp_matches(text, '[^\t-\r\x1c-\x1f\p{Z}]') THEN 'blank_summary'
        WHEN lang = 'fr' THEN 'url_not_http' END AS reason
    FROM documents"""


@check("vendor_news_validity", f"SELECT category, reason, count(*) AS n FROM ({_NEWS_REASON}) GROUP BY 1, 2")
def vendor_news_validity(spark, folder):
    rows = landing.news_items(news_payloads(spark, folder))
    return rows.groupBy("category", "reason").agg(F.count(F.lit(1)).alias("n"))


@check(
    "news_valid_counts",
    f"""SELECT category, count(*) FILTER (reason IS NULL) AS valid_count, count(*) FILTER (reason IS NOT NULL) AS invalid_count
    FROM ({_NEWS_REASON}) GROUP BY 1""",
)
def news_valid_counts(spark, folder):
    return valid_counts(landing.news_items(news_payloads(spark, folder)), ["category"])


@check(
    "quality_rate",
    f"""SELECT v AS valid_count, i AS invalid_count, round(v * 100.0 / (v + i), 6)::DOUBLE AS quality_rate, v * 100.0 / (v + i) < 95 AS degraded
    FROM (SELECT count(*) FILTER (reason IS NULL) AS v, count(*) FILTER (reason IS NOT NULL) AS i FROM ({_NEWS_REASON}))""",
)
def quality_rate_(spark, folder):
    return base.rounded(quality_rate(landing.news_items(news_payloads(spark, folder))), "quality_rate")


def series_payloads(spark, folder):
    """One response per event, going back a day at a time for fifteen days, oldest first."""
    day, back = F.to_date("observation_date"), F.sequence(F.lit(14), F.lit(0), F.lit(-1))
    rows = F.transform(
        back,
        lambda i: F.struct(
            F.date_sub(day, i).cast("string").alias("date"),
            F.when(i < 14, (F.col("arrival") + i).cast("string")).alias("value"),
            F.lit("2024-01-01").alias("realtime_start"),
        ),
    )
    return base.economic(spark, folder).select("series_id", F.to_json(F.struct(rows.alias("observations"))).alias("payload"))


def _back(days: int) -> str:
    return f"""
    SELECT series_id AS "seriesId", CAST(CAST(observation_date AS DATE) - i AS VARCHAR) AS "observationDate",
      CAST(seq + i AS VARCHAR) AS value, '2024-01-01' AS "realTimeStart", '' AS "realTimeEnd"
    FROM economic, (SELECT unnest(range({days}))::INT AS i)"""


@check("series_explode", _back(14), "economic")
def series_explode(spark, folder):
    """All observations; the oldest of each response has no value and is refused."""
    return accepted(landing.series_observations(series_payloads(spark, folder)))
