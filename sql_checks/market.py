"""Stock and market queries."""

from pyspark.sql import functions as F

from sql_checks import base
from sql_checks.base import AS_OF, NOON, check
from tapewright.functions.times import in_market_hours
from tapewright.operators.points import join_points, metric_point
from tapewright.operators.ranking import page_info
from tapewright.plans import market, stocks
from tapewright.plans.dashboard import dashboard


@check(
    "market_overview",
    f"""
    SELECT (SELECT count(*) FROM summaries) AS total_stocks, count(*) AS active_stocks,
      round(coalesce(avg(latest_risk_score), 0), 6) AS average_risk_score,
      count(*) FILTER (latest_risk_score > 70) AS high_risk_stocks,
      CASE WHEN (SELECT count(*) FROM summaries) = 0 THEN 'UNKNOWN'
        WHEN avg(CASE WHEN latest_trend = 'BULLISH' THEN 1.0 ELSE 0.0 END) > 0.6 THEN 'BULLISH'
        WHEN avg(CASE WHEN latest_trend = 'BEARISH' THEN 1.0 ELSE 0.0 END) > 0.6 THEN 'BEARISH' ELSE 'NEUTRAL' END
        AS market_sentiment, TIMESTAMP '{NOON}' AS last_updated
    FROM active""",
    "active",
)
def market_overview(spark, folder):
    return base.rounded(market.market_overview(base.summaries(spark, folder), NOON), "average_risk_score")


@check(
    "market_sentiment",
    """
    SELECT ts, CASE WHEN avg(CASE WHEN trend = 'BULLISH' THEN 1.0 ELSE 0.0 END) > 0.6 THEN 'BULLISH'
        WHEN avg(CASE WHEN trend = 'BEARISH' THEN 1.0 ELSE 0.0 END) > 0.6 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment
    FROM measured GROUP BY ts""",
    "measured",
)
def market_sentiment(spark, folder):
    """The sentiment rule applied to every day of the history."""
    return market.sentiment_by(base.measured(spark, folder), "ts", "trend")


@check("high_risk_symbols", "SELECT symbol, latest_risk_score FROM active WHERE latest_risk_score > 70", "active")
def high_risk_symbols(spark, folder):
    return market.high_risk_symbols(base.summaries(spark, folder), NOON)


_MOVER = """symbol, current_price, price_change_today AS change, price_change_percent_today AS change_percent,
      latest_volume AS volume"""
_LISTS = {
    "gainers": f"SELECT {_MOVER} FROM active WHERE price_change_percent_today > 0 ORDER BY price_change_percent_today DESC, symbol LIMIT 5",
    "losers": f"SELECT {_MOVER} FROM active WHERE price_change_percent_today < 0 ORDER BY price_change_percent_today, symbol LIMIT 5",
    "most_volatile": f"SELECT {_MOVER} FROM active ORDER BY latest_volatility DESC, symbol LIMIT 5",
}


def _active(spark, folder):
    return market.active_summaries(base.summaries(spark, folder), NOON)


@check("top_gainers", " " + _LISTS["gainers"], "active")
def top_gainers(spark, folder):
    return market.top_gainers(_active(spark, folder))


@check("top_losers", " " + _LISTS["losers"], "active")
def top_losers(spark, folder):
    return market.top_losers(_active(spark, folder))


@check("most_volatile", " " + _LISTS["most_volatile"], "active")
def most_volatile(spark, folder):
    return market.most_volatile(_active(spark, folder))


@check("top_movers_union", " " + " UNION ALL ".join(f"SELECT *, '{k}' AS list FROM ({q})" for k, q in _LISTS.items()), "active")
def top_movers_union(spark, folder):
    return market.top_movers(_active(spark, folder))


_RESPONSE = """symbol, current_price, latest_volume AS volume, latest_volatility AS volatility,
      price_change_today AS price_change, price_change_percent_today AS price_change_percent,
      CAST(NULL AS DOUBLE) AS volume_average, latest_risk_score AS risk_score, latest_trend AS trend,
      CAST(NULL AS DOUBLE) AS support, CAST(NULL AS DOUBLE) AS resistance, last_timestamp AS ts"""


def _envelope(view: str, page: int, size: int) -> str:
    total = f"(SELECT count(*) FROM {view})"
    pages = f"CAST(ceil({total} / {size}::DOUBLE) AS INT)"
    return (
        f"{page} AS page, {size} AS size, {total} AS total_elements, {pages} AS total_pages, "
        f"{page} < {pages} - 1 AS has_next, {'true' if page else 'false'} AS has_previous"
    )


@check("latest_stock", f" SELECT {_RESPONSE} FROM summaries WHERE symbol = 'SYM0007'", "summaries")
def latest_stock(spark, folder):
    return stocks.latest_stock(base.summaries(spark, folder), "sym0007")


@check(
    "stock_page",
    f" SELECT {_RESPONSE}, {_envelope('summaries', 1, 50)} FROM summaries ORDER BY symbol LIMIT 50 OFFSET 50",
    "summaries",
)
def stock_page(spark, folder):
    return stocks.stock_page(base.summaries(spark, folder), 1, 50)


@check("page_info", f" SELECT {_envelope('summaries', 9, 50)}", "summaries")
def page_info_(spark, folder):
    """The envelope of a page that may lie beyond the end."""
    return page_info(base.summaries(spark, folder), 9, 50)


@check(
    "stock_search_sort",
    " SELECT symbol, current_price, price_change_percent_today, latest_volume, latest_risk_score FROM summaries WHERE contains(lower(symbol), 'm00')",
    "summaries",
)
def stock_search_sort(spark, folder):
    found = stocks.search_stocks(base.summaries(spark, folder), "M00", "risk", descending=True)
    return found.select("symbol", "current_price", "price_change_percent_today", "latest_volume", "latest_risk_score")


_JOINED = """
      SELECT coalesce(p.symbol, m.symbol) AS symbol, coalesce(p.ts, m.ts) AS ts, p.close AS price, p.open, p.high, p.low,
        CAST(p.volume AS DOUBLE) AS volume, m.volatility, m.risk AS risk_score
      FROM price_points p FULL JOIN metric_points m ON p.symbol = m.symbol AND p.ts = m.ts"""


@check("stock_timeseries_join", _JOINED, "price_points", "metric_points")
def stock_timeseries_join(spark, folder):
    """The merge of price and metric points, of all symbols."""
    joined = metric_point(join_points(base.price_points(spark, folder), base.metric_points(spark, folder)))
    # A volume that may be missing is compared as a double.
    return joined.withColumn("volume", F.col("volume").cast("double"))


@check(
    "stock_timeseries",
    f" SELECT * FROM ({_JOINED}) WHERE symbol = 'SYM0003' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 480 HOURS AND ts < TIMESTAMP '{AS_OF}'",
    "price_points",
    "metric_points",
)
def stock_timeseries(spark, folder):
    """One symbol, resampled; daily points keep their place in daily windows."""
    prices, metrics = base.price_points(spark, folder), base.metric_points(spark, folder)
    rows = stocks.stock_timeseries(prices, metrics, "SYM0003", AS_OF, hours=480, window="1d")
    return rows.withColumn("volume", F.col("volume").cast("double"))


_MEANS = """
      SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' AS window_end, avg(volatility) AS v
      FROM ticks WHERE ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2"""
_MONTH = _MEANS.format(start="2024-01-01")


@check("market_volatility_15m", f" SELECT window_end, round(avg(v), 9) AS volatility FROM ({_MONTH}) GROUP BY 1", "ticks")
def market_volatility_15m(spark, folder):
    return base.rounded(market.market_volatility(base.ticks(spark, folder), AS_OF, hours=720), "volatility", digits=9)


@check("market_volatility_collapsed", f" SELECT round(avg(v), 9) AS volatility FROM ({_MONTH})", "ticks")
def market_volatility_collapsed(spark, folder):
    return base.rounded(market.market_volatility(base.ticks(spark, folder), AS_OF, hours=720, collapse=True), "volatility", digits=9)


@check(
    "symbol_volatility_15m",
    f" SELECT symbol, window_end, round(v, 9) AS volatility FROM ({_MEANS.format(start='1970-01-01')})",
    "ticks",
)
def symbol_volatility_15m(spark, folder):
    from tapewright.operators.points import windowed_mean

    return base.rounded(windowed_mean(base.ticks(spark, folder), "volatility"), "volatility", digits=9)


@check(
    "top_performers",
    f"""
    SELECT symbol, change_percent FROM (SELECT symbol, max_by(pct, ts) AS change_percent FROM metric_points
      WHERE ts >= TIMESTAMP '{NOON}' - INTERVAL 24 HOURS AND ts < TIMESTAMP '{NOON}' GROUP BY 1)
    ORDER BY change_percent DESC, symbol LIMIT 10""",
    "metric_points",
)
def top_performers(spark, folder):
    """Candles are daily, so the span is a day instead of the hour of live points."""
    return stocks.top_performers(base.metric_points(spark, folder), NOON, hours=24)


_HISTORY = """(SELECT * FROM measured WHERE symbol = 'SYM0007' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28')"""


@check(
    "stock_history",
    f"""
    SELECT symbol, ts, close AS price, open, high, low, volume, volatility, risk AS risk_score, trend,
      {_envelope(_HISTORY, 1, 8)}
    FROM {_HISTORY} ORDER BY ts DESC LIMIT 8 OFFSET 8""",
    "measured",
)
def stock_history(spark, folder):
    rows = base.measured(spark, folder)
    return stocks.stock_history(rows, "SYM0007", "2024-01-03", "2024-01-28 00:00:00", page=1, size=8)


@check(
    "risk_tiers",
    """
    SELECT CASE WHEN latest_risk_score >= 70 THEN 'high' WHEN latest_risk_score >= 40 THEN 'medium' ELSE 'low' END AS tier,
      CASE WHEN price_change_today > 0 THEN 'up' WHEN price_change_today < 0 THEN 'down' ELSE 'flat' END AS direction,
      count(*) AS symbols
    FROM summaries GROUP BY 1, 2""",
    "summaries",
)
def risk_tiers(spark, folder):
    return stocks.risk_distribution(base.summaries(spark, folder))


@check(
    "market_hours_ticks",
    """ SELECT symbol, ts, volatility FROM (SELECT *, ts - INTERVAL 5 HOURS AS clock FROM ticks)
    WHERE dayofweek(clock) BETWEEN 1 AND 5 AND hour(clock) * 60 + minute(clock) >= 570 AND hour(clock) < 16""",
    "ticks",
)
def market_hours_ticks(spark, folder):
    """The tables' January lies in standard time, five hours behind UTC."""
    return base.ticks(spark, folder).where(in_market_hours(F.col("ts").cast("timestamp")))


@check(
    "active_summaries",
    " SELECT symbol, last_timestamp, latest_risk_score FROM active",
    "active",
)
def active_summaries(spark, folder):
    return _active(spark, folder).select("symbol", "last_timestamp", "latest_risk_score")


def _boards(spark, folder):
    return dashboard(
        base.summaries(spark, folder),
        base.indicators(spark, folder),
        base.metadata(spark, folder),
        base.news(spark, folder),
        AS_OF,
    )


@check("dashboard_stocks", " SELECT symbol, current_price, latest_trend AS trend FROM summaries ORDER BY symbol LIMIT 12", "summaries")
def dashboard_stocks(spark, folder):
    return _boards(spark, folder)["stocks"].select("symbol", "current_price", "trend")


@check("dashboard_indicators", " SELECT indicator AS series_id, latest_value AS value FROM indicators ORDER BY 1 LIMIT 6", "indicators")
def dashboard_indicators(spark, folder):
    return _boards(spark, folder)["indicators"].select("series_id", "value")


@check(
    "dashboard_news",
    f" SELECT id, ts, sentiment FROM news WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS ORDER BY ts DESC, id LIMIT 9",
    "news",
)
def dashboard_news(spark, folder):
    return _boards(spark, folder)["news"].select("id", "ts", "sentiment")
