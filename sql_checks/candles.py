"""Candle validity, measures and summaries."""

from pyspark.sql import functions as F

from sql_checks import base
from sql_checks.base import check
from tapewright.functions.checks import candle_reason
from tapewright.operators.points import pivot_points, price_domain, resample, to_long, METRIC_FIELDS
from tapewright.operators.returns import support_resistance, volume_average
from tapewright.operators.series import with_position
from tapewright.plans import stocks


@check(
    "candle_metrics",
    """
    SELECT symbol, ts, volatility, change AS price_change, pct AS price_change_percent, risk AS risk_score, trend,
      CAST(volume AS DOUBLE) AS volume_average, '2024-01-31' AS calculation_date,
      CASE trend WHEN 'BULLISH' THEN 1.0 WHEN 'BEARISH' THEN -1.0 ELSE 0.0 END::DOUBLE AS trend_numeric
    FROM measured""",
    "measured",
)
def candle_metrics(spark, folder):
    from tapewright.functions.measures import trend_number

    return base.measured(spark, folder).select(
        "symbol", "ts", "volatility", "price_change", "price_change_percent", "risk_score", "trend",
        "volume_average", "calculation_date", trend_number(F.col("trend")).alias("trend_numeric"),
    )


_RAW = """
    SELECT CASE WHEN event_type = 'signup' AND value < 1 THEN '' ELSE concat('SYM', CAST(user_id AS VARCHAR)) END AS symbol,
      CASE WHEN value > 200 THEN NULL ELSE ts END AS ts, value - 2 AS open,
      CASE WHEN event_type = 'error' THEN value - 3 ELSE value + 1 END AS high, value - 2.5 AS low,
      CASE WHEN event_type = 'view' AND value > 100 THEN NULL ELSE value END AS close,
      CASE WHEN event_type = 'click' AND value > 150 THEN NULL ELSE event_id END AS volume
    FROM events"""

_REASON = """
    CASE WHEN symbol = '' THEN 'blank_symbol' WHEN ts IS NULL THEN 'missing_time'
      WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'missing_price'
      WHEN volume IS NULL THEN 'missing_volume'
      WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'price_not_positive'
      WHEN high < low THEN 'high_below_low' END"""


def raw_candles(spark, folder):
    """Events as candles of which some break each rule."""
    kind, value = F.col("event_type"), F.col("value")
    return base.table(spark, folder, "events").select(
        F.when((kind == "signup") & (value < 1), "")
        .otherwise(F.concat(F.lit("SYM"), F.col("user_id").cast("string")))
        .alias("symbol"),
        F.when(~(value > 200), F.col("ts")).alias("ts"),
        (value - 2).alias("open"),
        F.when(kind == "error", value - 3).otherwise(value + 1).alias("high"),
        (value - 2.5).alias("low"),
        F.when(~((kind == "view") & (value > 100)), value).alias("close"),
        F.when(~((kind == "click") & (value > 150)), F.col("event_id")).alias("volume"),
    ).withColumn("reason", candle_reason())


@check("candle_validity", f"SELECT symbol, ts, open, high, low, close, volume FROM (SELECT *, {_REASON} AS reason FROM ({_RAW})) WHERE reason IS NULL")
def candle_validity(spark, folder):
    return raw_candles(spark, folder).where(F.col("reason").isNull()).drop("reason")


@check(
    "candle_rejects",
    f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM ({_RAW})) WHERE reason IS NOT NULL GROUP BY 1",
)
def candle_rejects(spark, folder):
    rejects = raw_candles(spark, folder).where(F.col("reason").isNotNull())
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@check("trend_counts", "SELECT trend, count(*) AS n FROM measured GROUP BY 1", "measured")
def trend_counts(spark, folder):
    return base.measured(spark, folder).groupBy("trend").agg(F.count(F.lit(1)).alias("n"))


@check("latest_summary", "SELECT *, '2024-01-31' AS calculation_date FROM summaries", "summaries")
def latest_summary(spark, folder):
    return base.summaries(spark, folder)


@check("distinct_symbols", "SELECT DISTINCT symbol FROM candles", "candles")
def distinct_symbols(spark, folder):
    return stocks.distinct_symbols(base.candles(spark, folder))


@check(
    "resample_candles",
    """
    SELECT symbol, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS ts, min_by(open, ts) AS open,
      max(high) AS high, min(low) AS low, max_by(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume
    FROM candles GROUP BY 1, 2""",
    "candles",
)
def resample_candles(spark, folder):
    return resample(base.candles(spark, folder), "7 days")


_LONG = " UNION ALL ".join(
    f"SELECT symbol, ts, '{field}' AS field, CAST({column} AS DOUBLE) AS value FROM metric_points"
    for field, column in (
        ("volatility", "volatility"),
        ("risk_score", "risk"),
        ("price_change", "change"),
        ("price_change_percent", "pct"),
        ("trend_numeric", "CASE trend WHEN 'BULLISH' THEN 1 WHEN 'BEARISH' THEN -1 ELSE 0 END"),
    )
)


@check("points_long", _LONG, "metric_points")
def points_long(spark, folder):
    return to_long(base.metric_points(spark, folder), METRIC_FIELDS)


@check(
    "points_pivot",
    """
    SELECT symbol, ts, volatility, risk AS risk_score, change AS price_change, pct AS price_change_percent,
      CASE trend WHEN 'BULLISH' THEN 1.0 WHEN 'BEARISH' THEN -1.0 ELSE 0.0 END::DOUBLE AS trend_numeric
    FROM metric_points""",
    "metric_points",
)
def points_pivot(spark, folder):
    return pivot_points(to_long(base.metric_points(spark, folder), METRIC_FIELDS), METRIC_FIELDS)


@check(
    "price_domain",
    """
    SELECT symbol, lo AS min_price, hi AS max_price, lo - (hi - lo) * 0.05::DOUBLE AS lower_bound,
      hi + (hi - lo) * 0.05::DOUBLE AS upper_bound
    FROM (SELECT symbol, min(close) AS lo, max(close) AS hi FROM candles GROUP BY 1)""",
    "candles",
)
def price_domain_(spark, folder):
    return price_domain(base.candles(spark, folder))


@check(
    "price_positions",
    """
    SELECT symbol, ts, value, position FROM (
      SELECT printf('SYM%04d', user_id) AS symbol, ts,
        CASE WHEN event_type <> 'error' THEN value END AS value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS position
      FROM events) WHERE value IS NOT NULL""",
)
def price_positions(spark, folder):
    """Chart points: places in the full series, then points without a price dropped."""
    events = base.table(spark, folder, "events").select(
        base.symbol_of("user_id").alias("symbol"), "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    return with_position(events, "symbol", "ts").where(F.col("value").isNotNull())


@check(
    "volume_average",
    """
    SELECT symbol, ts, round(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6)
      AS volume_average FROM candles""",
    "candles",
)
def volume_average_(spark, folder):
    return base.rounded(volume_average(base.candles(spark, folder)).select("symbol", "ts", "volume_average"), "volume_average")


@check(
    "support_resistance",
    """
    SELECT symbol, ts, min(low) OVER w AS support, max(high) OVER w AS resistance FROM candles
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "candles",
)
def support_resistance_(spark, folder):
    return support_resistance(base.candles(spark, folder)).select("symbol", "ts", "support", "resistance")
