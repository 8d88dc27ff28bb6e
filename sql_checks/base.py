"""Registry of checked queries, and the market views over the supplied tables in both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.functions.measures import with_measures
from tapewright.functions.text import news_id, sentiment
from tapewright.functions.times import date_bucket
from tapewright.plans.economy import parse_observations
from tapewright.plans.stocks import summarise

AS_OF = "2024-01-31 00:00:00"
# Candles are stamped at the start of their day, so "the last 24 hours" is asked at noon.
NOON = "2024-01-30 12:00:00"

# Lexicon for the supplied prose, which is not English market news.
POSITIVE = ("the", "and", "with", "ing", "tion")
NEGATIVE = ("keit", "sch", "que", "ado", "ción")

BENCHMARK = "SYM0000"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query with its SQL; `views` names the shared views the SQL reads."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return build

    return register


# ---- views, SQL side ---------------------------------------------------------------------------


def _term_hits(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(t, '{term}') AS INT)" for term in terms)


def uuid_sql(name: str) -> str:
    digest = f"md5({name})"
    variant = f"translate(substr({digest}, 17, 1), '0123456789abcdef', '{'89ab' * 4}')"
    return (
        f"concat(substr({digest}, 1, 8), '-', substr({digest}, 9, 4), '-3', substr({digest}, 14, 3), '-', "
        f"{variant}, substr({digest}, 18, 3), '-', substr({digest}, 21, 12))"
    )


def candles_sql(where: str = "value > 0") -> str:
    return f"""
      SELECT printf('SYM%04d', user_id) AS symbol,
        CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts,
        min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close,
        CAST(count(*) * 100 AS BIGINT) AS volume
      FROM events WHERE {where} GROUP BY 1, 2"""


def measured_sql(source: str) -> str:
    return f"""
      SELECT *, CASE WHEN pct > 1.0 THEN 'BULLISH' WHEN pct < -1.0 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend
      FROM (SELECT *, CASE WHEN open > 0 THEN change / open * 100.0 ELSE 0.0 END AS pct, volatility * 100.0 AS risk
        FROM (SELECT *, CASE WHEN high > low AND close > 0 THEN (high - low) / close ELSE 0.0 END AS volatility,
            close - open AS change FROM {source}))"""


# name -> (views it reads, SQL)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "candles": ((), candles_sql()),
    "measured": (("candles",), measured_sql("candles")),
    "summaries": (
        ("measured",),
        """
      SELECT symbol, ts AS last_timestamp, close AS current_price, volume AS latest_volume,
        volatility AS latest_volatility, risk AS latest_risk_score, trend AS latest_trend,
        change AS price_change_today, pct AS price_change_percent_today
      FROM measured QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""",
    ),
    "active": (
        ("summaries",),
        f"SELECT * FROM summaries WHERE last_timestamp > TIMESTAMP '{NOON}' - INTERVAL 24 HOURS",
    ),
    "price_points": ((), candles_sql("value > 0 AND event_type <> 'error'")),
    "metric_points": (("metric_candles",), measured_sql("metric_candles")),
    "metric_candles": ((), candles_sql("value > 0 AND event_type <> 'signup'")),
    "ticks": (
        (),
        "SELECT printf('SYM%04d', user_id) AS symbol, ts, value AS volatility FROM events",
    ),
    "news": (
        (),
        f"""
      SELECT {uuid_sql("concat(headline, url)")} AS id, headline, summary, source, related_symbol, ts,
        CAST(CAST(ts AS DATE) AS VARCHAR) AS date_bucket,
        CASE WHEN lead >= 2 THEN 'POSITIVE' WHEN lead <= -2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment
      FROM (SELECT *, ({_term_hits(POSITIVE)}) - ({_term_hits(NEGATIVE)}) AS lead
        FROM (SELECT *, lower(concat(headline, ' ', summary)) AS t
          FROM (SELECT concat('Report ', CAST(doc_id AS VARCHAR), ' (', lang, ') from ', source) AS headline,
              text AS summary, source, concat('http://news.example/', CAST(doc_id AS VARCHAR)) AS url,
              CASE WHEN doc_id % 4 = 0 THEN NULL
                ELSE printf('SYM%04d', doc_id % 150) END AS related_symbol,
              TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST((doc_id % 1000) * 43 AS INT) AS ts
            FROM documents)))""",
    ),
    "economic": (
        (),
        """
      SELECT upper(event_type) AS series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS observation_date,
        CASE WHEN event_id % 17 = 0 THEN '.' WHEN event_id % 29 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS raw_value,
        event_id AS seq, ts AS processed_at
      FROM events""",
    ),
    "observations": (
        ("economic",),
        """
      SELECT series_id, CAST(CAST(observation_date AS DATE) AS TIMESTAMP) AS ts, CAST(raw_value AS DOUBLE) AS value,
        observation_date, seq, processed_at
      FROM economic WHERE raw_value NOT IN ('.', 'n/a')
      QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY seq DESC) = 1""",
    ),
    "indicators": (
        ("observations",),
        """
      SELECT series_id AS indicator, processed_at AS last_timestamp, value AS latest_value, observation_date
      FROM observations QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, seq DESC) = 1""",
    ),
    "metadata": (
        (),
        """
      SELECT DISTINCT upper(event_type) AS series_id, concat('Count of ', event_type) AS title, 'Daily' AS frequency,
        'Units' AS units, CAST(NULL AS VARCHAR) AS notes, 'Events' AS source
      FROM events WHERE event_type <> 'error'""",
    ),
    "instruments": (
        (),
        """
      SELECT printf('SYM%04d', c_custkey) AS symbol, c_name AS name, 'XTST' AS exchange,
        'USD' AS currency, c_mktsegment AS sector
      FROM customer WHERE c_acctbal > 0""",
    ),
    "requests": ((), "SELECT event_type AS service, ts, event_id % 10 <> 0 AS ok FROM events"),
    "returns": (
        ("candles",),
        """
      SELECT symbol, CAST(ts AS DATE) AS day, close,
        close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret
      FROM candles""",
    ),
}


def with_views(sql: str, *views: str) -> str:
    """Put the named views, and those they read, in front of the query as CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in _VIEWS[name][0]:
            visit(needed)
        ordered.append(name)

    for view in views:
        visit(view)
    if not ordered:
        return sql.strip()
    return "WITH " + ",\n".join(f"{name} AS ({_VIEWS[name][1]})" for name in ordered) + sql


# ---- views, Spark side -------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def symbol_of(number: str) -> Column:
    return F.format_string("SYM%04d", F.col(number))


def candles_from(events: DataFrame) -> DataFrame:
    """Daily candles; grouped on the raw user number, so keys stay fixed-width in the hash map."""
    grouped = (
        events.where(F.col("value") > 0)
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            F.min_by("value", "ts").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "ts").alias("close"),
            (F.count(F.lit(1)) * 100).alias("volume"),
        )
    )
    return grouped.select(
        symbol_of("user_id").alias("symbol"),
        F.col("day").cast("timestamp_ntz").alias("ts"),
        "open",
        "high",
        "low",
        "close",
        "volume",
    )


def candles(spark: SparkSession, folder: str) -> DataFrame:
    return candles_from(table(spark, folder, "events"))


def measured(spark: SparkSession, folder: str) -> DataFrame:
    return with_measures(candles(spark, folder), AS_OF)


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    return summarise(candles(spark, folder), AS_OF)


def price_points(spark: SparkSession, folder: str) -> DataFrame:
    """Candles of every feed but one."""
    return candles_from(table(spark, folder, "events").where(F.col("event_type") != "error"))


def metric_points(spark: SparkSession, folder: str) -> DataFrame:
    """Measures over another choice of feeds, so that either side of the join may be missing."""
    from tapewright.functions.measures import stored_metrics

    feeds = candles_from(table(spark, folder, "events").where(F.col("event_type") != "signup"))
    return stored_metrics(with_measures(feeds, AS_OF))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a volatility point of its symbol."""
    events = table(spark, folder, "events")
    return events.select(symbol_of("user_id").alias("symbol"), "ts", F.col("value").alias("volatility"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as news, whole texts."""
    doc = F.col("doc_id")
    minutes = (F.pmod(doc, F.lit(1000)) * 43).cast("int")
    return table(spark, folder, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.lit("Report "), doc.cast("string"), F.lit(" ("), "lang", F.lit(") from "), "source").alias("headline"),
        F.col("text").alias("summary"),
        "source",
        F.concat(F.lit("http://news.example/"), doc.cast("string")).alias("url"),
        F.when(doc % 4 != 0, F.format_string("SYM%04d", doc % 150)).alias("related_symbol"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)).alias("ts"),
    )


def news(spark: SparkSession, folder: str) -> DataFrame:
    items = articles(spark, folder)
    return items.select(
        news_id(F.col("headline"), F.col("url")).alias("id"),
        "headline",
        "summary",
        "source",
        "related_symbol",
        "ts",
        date_bucket(F.col("ts")).alias("date_bucket"),
        sentiment(F.col("headline"), F.col("summary"), POSITIVE, NEGATIVE).alias("sentiment"),
    )


def economic(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("event_id")
    return table(spark, folder, "events").select(
        F.upper("event_type").alias("series_id"),
        F.to_date("ts").cast("string").alias("observation_date"),
        F.when(number % 17 == 0, ".").when(number % 29 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        number.alias("arrival"),
        F.col("ts").alias("processed_at"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Good observations, the last arrival per series and date."""
    from tapewright.operators.latest import latest_by_unique

    good = parse_observations(economic(spark, folder)).where(F.col("reason").isNull())
    rows = good.select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "arrival", "processed_at")
    return latest_by_unique(rows, ["series_id", "ts"], "arrival").withColumn(
        "observation_date", F.to_date("ts").cast("string")
    )


def indicators(spark: SparkSession, folder: str) -> DataFrame:
    from tapewright.plans.economy import latest_indicators

    return latest_indicators(observations(spark, folder))


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where(F.col("event_type") != "error")
    return events.select("event_type").distinct().select(
        F.upper("event_type").alias("series_id"),
        F.concat(F.lit("Count of "), "event_type").alias("title"),
        F.lit("Daily").alias("frequency"),
        F.lit("Units").alias("units"),
        F.lit(None).cast("string").alias("notes"),
        F.lit("Events").alias("source"),
    )


def instruments(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").where(F.col("c_acctbal") > 0)
    nothing = F.lit(None).cast("string")
    return customers.select(
        symbol_of("c_custkey").alias("symbol"),
        F.col("c_name").alias("name"),
        F.lit("XTST").alias("exchange"),
        F.lit("USD").alias("currency"),
        F.col("c_mktsegment").alias("sector"),
        nothing.alias("industry"),
        nothing.alias("description"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    ok = (F.col("event_id") % 10 != 0).cast("int")
    return table(spark, folder, "events").select(F.col("event_type").alias("service"), "ts", ok.alias("ok"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums are added in another order here than in the SQL, hence rounding."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


WIRE_COLUMNS = [name for name, _, _ in schemas.CANDLE_WIRE]
