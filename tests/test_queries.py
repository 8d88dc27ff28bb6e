import pytest
from helpers import INF, NAN, at, rows, times
from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.functions.measures import stored_metrics, with_measures
from tapewright.plans import dashboard, economy, market, news, risk, stocks

AS_OF = "2024-01-31 00:00:00"
RECENT = at("2024-01-30 12:00:00")
SUMMARY = (
    "symbol string, last_timestamp timestamp, current_price double, latest_volume long, latest_volatility double, "
    "latest_risk_score double, latest_trend string, price_change_today double, price_change_percent_today double"
)


def summaries(spark, *data):
    """(symbol, changes) pairs over an ordinary row."""
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    base = dict(zip(names, (None, RECENT, 10.0, 5, 0.1, 10.0, "NEUTRAL", 0.0, 0.0)))
    return spark.createDataFrame([tuple({**base, "symbol": s, **changes}[n] for n in names) for s, changes in data], SUMMARY)


# ---- overview ------------------------------------------------------------------------------------


def overview(spark, *data):
    return market.market_overview(summaries(spark, *data), AS_OF).first()


def test_overview_of_nothing(spark):
    row = overview(spark)
    assert (row.total_stocks, row.active_stocks, row.average_risk_score, row.market_sentiment) == (0, 0, 0.0, "UNKNOWN")


def test_overview_without_active_symbols(spark):
    row = overview(spark, ("A", {"last_timestamp": at("2024-01-30 00:00:00")}), ("B", {"last_timestamp": at("2024-01-01")}))
    assert (row.total_stocks, row.active_stocks, row.average_risk_score, row.market_sentiment) == (2, 0, 0.0, "NEUTRAL")


def test_overview_counts_and_risk(spark):
    row = overview(
        spark,
        ("A", {"latest_risk_score": 70.0}),
        ("B", {"latest_risk_score": 70.1}),
        ("C", {"latest_risk_score": NAN}),
        ("D", {"latest_risk_score": None, "last_timestamp": None}),
        ("E", {"latest_risk_score": INF}),
        (" ", {}),
        ("F", {"current_price": -1.0}),
        ("G", {"current_price": None, "latest_risk_score": 0.0}),
        ("H", {"current_price": NAN}),
    )
    assert (row.total_stocks, row.active_stocks, row.high_risk_stocks) == (6, 6, 2)
    assert row.average_risk_score == pytest.approx((70.0 + 70.1 + 0.0) / 3)


@pytest.mark.parametrize(("up", "down", "other", "mood"), [(3, 1, 1, "NEUTRAL"), (4, 1, 1, "BULLISH"), (1, 4, 1, "BEARISH"), (0, 3, 2, "NEUTRAL")])
def test_sentiment_needs_more_than_sixty_percent(spark, up, down, other, mood):
    trends = ["BULLISH"] * up + ["BEARISH"] * down + ["NEUTRAL"] * other
    assert overview(spark, *((f"S{i}", {"latest_trend": t}) for i, t in enumerate(trends))).market_sentiment == mood


def test_high_risk_symbols_are_rows(spark):
    df = summaries(spark, ("B", {"latest_risk_score": 90.0}), ("A", {"latest_risk_score": 71.0}), ("C", {"latest_risk_score": 70.0}), ("D", {"latest_risk_score": NAN}))
    assert [r.symbol for r in market.high_risk_symbols(df, AS_OF).collect()] == ["A", "B"]


def test_movers(spark):
    changes = {"A": 3.0, "B": -2.0, "C": 3.0, "D": None, "E": NAN, "F": 0.0, "G": 9.0, "H": 1.0, "I": 2.0, "J": 0.5, "K": -8.0}
    df = summaries(spark, *((s, {"price_change_percent_today": v, "latest_volatility": NAN if s == "G" else None if s == "A" else ord(s) / 100}) for s, v in changes.items()))
    assert [r.symbol for r in market.top_gainers(df).collect()] == ["G", "A", "C", "I", "H"]
    assert [r.symbol for r in market.top_losers(df).collect()] == ["K", "B"]
    assert [r.symbol for r in market.most_volatile(df).collect()] == ["K", "J", "I", "H", "F"]
    union = rows(market.top_movers(df), "list", "symbol")
    assert union == sorted([("gainers", s) for s in "GACIH"] + [("losers", s) for s in "KB"] + [("most_volatile", s) for s in "KJIHF"])


# ---- stocks --------------------------------------------------------------------------------------


def test_latest_stock_and_response_defaults(spark):
    df = summaries(spark, ("AAPL", {"current_price": None, "last_timestamp": None}))
    (row,) = times(stocks.latest_stock(df, "aapl"), "ts").collect()
    assert (row.current_price, row.ts, row.support, row.resistance, row.volume_average) == (0.0, "1970-01-01 00:00:00", None, None, None)
    assert stocks.latest_stock(df, "MSFT").count() == 0


def test_stock_pages_leave_out_invalid_symbols(spark):
    df = summaries(spark, ("B", {}), ("A", {}), ("", {}), ("C", {"current_price": -1.0}))
    (row,) = stocks.stock_page(df, 0, 1).collect()
    assert (row.symbol, row.total_elements, row.total_pages, row.has_next) == ("A", 2, 2, True)


def test_search_and_sort(spark):
    df = summaries(
        spark, ("AAPL", {"latest_volume": 3}), ("GOOGL", {"latest_volume": None}), ("GOOG", {"latest_volume": -1}), ("MSFT", {"latest_volume": 9})
    )

    def found(*args, **kw):
        return [r.symbol for r in stocks.search_stocks(df, *args, **kw).collect()]

    assert found("goog") == ["GOOG", "GOOGL"]
    assert found("", "volume") == ["GOOG", "GOOGL", "AAPL", "MSFT"]  # missing sorts as zero
    assert found("", "volume", descending=True) == ["MSFT", "AAPL", "GOOGL", "GOOG"]
    assert found(descending=True)[0] == "MSFT"
    with pytest.raises(KeyError):
        found("", "price")


@pytest.fixture(scope="module")
def candles(spark):
    data = [("A", at(f"2024-01-30 {h:02d}:{m:02d}:00"), h + 1.0, h + 3.0, h + 0.5, h + 2.0, m + 1.0) for h in range(24) for m in (0, 2, 30)]
    return spark.createDataFrame(data, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def test_timeseries_with_and_without_window(spark, candles):
    metrics = stored_metrics(with_measures(candles.where("minute(ts) <> 30"), AS_OF))
    literal = times(stocks.stock_timeseries(candles, metrics, "a", AS_OF, hours=1, window=None), "ts").collect()
    assert [(r.ts[11:16], r.price, r.volatility is None) for r in literal] == [("23:00", 25.0, False), ("23:02", 25.0, False), ("23:30", 25.0, True)]
    resampled = times(stocks.stock_timeseries(candles, metrics, "A", AS_OF, hours=1), "ts").collect()
    assert [(r.ts[11:16], r.volume) for r in resampled] == [("23:00", 4), ("23:30", 31)]
    assert stocks.stock_timeseries(candles, metrics, "B", AS_OF).count() == 0
    for bad in ("5", "m", "0m", "5w", "fivem"):
        with pytest.raises(ValueError):
            stocks.stock_timeseries(candles, metrics, "A", AS_OF, window=bad)


def test_range_start_is_inclusive_and_stop_exclusive(spark):
    points = spark.createDataFrame([("A", at(t), 1.0) for t in ("2024-01-30 00:00:00", "2024-01-30 23:59:59", "2024-01-31 00:00:00")],
                                   "symbol string, ts timestamp, price_change_percent double")
    kept = stocks._in_range(points, "A", AS_OF, 24)
    assert kept.count() == 2


def test_top_performers(spark):
    data = [
        ("A", "23:10", 1.0), ("A", "23:50", 5.5), ("B", "23:40", 9.0), ("B", "23:55", 3.2), ("C", "23:59", NAN), ("D", "23:59", INF),
        ("E", "22:30", 50.0), ("F", "23:20", 3.2), ("G", "23:30", None),
    ]
    df = spark.createDataFrame([(s, at(f"2024-01-30 {t}:00"), v) for s, t, v in data], "symbol string, ts timestamp, price_change_percent double")
    assert [(r.symbol, r.change_percent) for r in stocks.top_performers(df, AS_OF).collect()] == [("A", 5.5), ("B", 3.2), ("F", 3.2)]
    assert [r.symbol for r in stocks.top_performers(df, AS_OF, limit=1).collect()] == ["A"]


def test_market_volatility(spark):
    df = spark.createDataFrame(
        [("A", at("2024-01-30 10:01:00"), 0.1), ("A", at("2024-01-30 10:14:59"), 0.3), ("B", at("2024-01-30 10:02:00"), 0.6), ("A", at("2024-01-30 10:15:00"), 0.5),
         ("A", at("2024-01-29 10:15:00"), 9.0)],
        "symbol string, ts timestamp, volatility double",
    )
    got = [(r.window_end[11:16], round(r.volatility, 9)) for r in times(market.market_volatility(df, AS_OF), "window_end").collect()]
    assert got == [("10:15", 0.4), ("10:30", 0.5)]
    assert market.market_volatility(df, AS_OF, collapse=True).first().volatility == pytest.approx((0.2 + 0.6 + 0.5) / 3)


def test_history_bounds_are_inclusive(spark, candles):
    rows_ = with_measures(candles, AS_OF)
    got = stocks.stock_history(rows_, "a", "2024-01-30 10:00:00", "2024-01-30 11:00:00", page=0, size=3)
    found = times(got, "ts").collect()
    assert [r.ts[11:16] for r in found] == ["11:00", "10:30", "10:02"] and found[0].total_elements == 4
    assert [r.ts[11:16] for r in times(stocks.stock_history(rows_, "A", None, None, 23, 3), "ts").collect()] == ["00:30", "00:02", "00:00"]
    assert stocks.distinct_symbols(candles).count() == 1


# ---- news ----------------------------------------------------------------------------------------

NEWS = "id string, ts timestamp, headline string, summary string, sentiment string, source string, related_symbol string"


@pytest.fixture(scope="module")
def articles(spark):
    """One item an hour over ten days, the newest at 23:00; every 40th is negative and about AAPL."""
    df = spark.range(240).select(
        F.format_string("id%03d", F.col("id")).alias("id"),
        (F.lit("2024-01-30 23:00:00").cast("timestamp") - F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"),
        F.lit("h").alias("headline"),
        F.lit("s").alias("summary"),
        F.when(F.col("id") % 40 == 39, "NEGATIVE").otherwise("NEUTRAL").alias("sentiment"),
        F.lit("src").alias("source"),
        F.when(F.col("id") % 40 == 39, "AAPL").alias("related_symbol"),
    )
    return df.withColumn("date_bucket", F.to_date("ts").cast("string"))


def ids(df):
    return [int(r.id[2:]) for r in df.collect()]


def test_recent_news(articles):
    # The item exactly 24 hours before as_of (23:00 the day before minus an hour) is not after the cutoff.
    assert ids(news.recent_news(articles, AS_OF)) == list(range(23))
    assert ids(news.recent_news(articles, AS_OF, hours=1000, limit=5)) == [0, 1, 2, 3, 4]
    assert ids(news.recent_news(articles, AS_OF, hours=1000, limit=500, depth=2)) == list(range(24))
    assert len(ids(news.recent_news(articles, AS_OF, hours=1000, limit=500))) == articles.count()
    assert len(ids(news.recent_news(articles, AS_OF, hours=1000, limit=500, depth=7))) == 6 * 24


def test_filters_come_before_the_cut(articles):
    assert ids(news.news_by_sentiment(articles, "negative", AS_OF, hours=1000, limit=3)) == [39, 79, 119]
    assert ids(news.news_for_symbol(articles, "aapl", AS_OF, hours=1000, limit=2)) == [39, 79]
    assert ids(news.news_for_symbol(articles, "aapl", AS_OF, hours=1000, depth=2)) == []


def test_bucket_queries(articles):
    assert ids(news.bucket_page(articles, "2024-01-29", 2)) == [24, 25]
    tops = rows(news.bucket_top(articles, 1), "date_bucket", "id")
    assert len(tops) == 10 and tops[-1] == ("2024-01-30", "id000")


# ---- economy -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def indicators(spark):
    return spark.createDataFrame(
        [("VIXCLS", at("2024-01-16 10:00:00"), 18.75, "2024-01-15"), ("FEDFUNDS", at("2024-01-20 10:00:00"), 0.05, "n/a"), ("OLD", None, 1.0, None), (" ", None, 2.0, None)],
        "indicator string, last_timestamp timestamp, latest_value double, observation_date string",
    )


def test_indicator_lookup_and_pages(spark, indicators):
    meta = economy.known_metadata(spark, "2024-01-01 00:00:00")
    (row,) = economy.indicator(indicators, meta, "vixcls", AS_OF).collect()
    assert (row.series_id, row.observation_date, row.value, row.title) == ("VIXCLS", "2024-01-15", 18.75, "CBOE Volatility Index: VIX")
    page = economy.indicator_page(indicators, meta, AS_OF, 0, 2).orderBy("series_id").collect()
    assert [(r.series_id, r.observation_date, r.title, r.total_elements) for r in page] == [
        ("FEDFUNDS", "2024-01-20", None, 3), ("OLD", "2024-01-31", None, 3),
    ]
    assert economy.indicator(indicators, meta, "none", AS_OF).count() == 0


def test_observation_queries(spark):
    df = spark.createDataFrame([("DGS10", at(f"2024-01-{d:02d}"), float(d)) for d in range(1, 31)] + [("X", at("2024-01-05"), 1.0)],
                               "series_id string, ts timestamp, value double")
    meta = economy.known_metadata(spark, "2024-01-01 00:00:00")
    assert [r.value for r in economy.indicator_timeseries(df, "dgs10", AS_OF, days=3).collect()] == [28.0, 29.0, 30.0]
    got = economy.indicator_observations(df, meta, "dgs10", "2024-01-10", "2024-01-20", limit=3).orderBy("ts").collect()
    assert [(r.value, r.units) for r in got] == [(18.0, "Percent"), (19.0, "Percent"), (20.0, "Percent")]
    assert economy.indicator_observations(df, meta, "DGS10", limit=100).count() == 30
    assert rows(economy.newest_observations(df, 2), "series_id", "value") == [("DGS10", 29.0), ("DGS10", 30.0), ("X", 1.0)]
    with pytest.raises(ValueError):
        economy.indicator_observations(df, meta, "DGS10", limit=0)
    with pytest.raises(ValueError):
        economy.indicator_observations(df, meta, "DGS10", "10.01.2024")


def test_metadata_is_inserted_only_when_absent(spark):
    known = economy.known_metadata(spark, "2024-01-01 00:00:00")
    existing = known.where("series_id = 'SP500'").withColumn("title", F.lit("edited"))
    series = spark.createDataFrame([("vixcls",), ("VIXCLS",), ("SP500",), ("UNKNOWN",)], "series_id string")
    assert rows(economy.missing_metadata(series, known, existing), "series_id", "frequency") == [("VIXCLS", "Daily")]
    assert known.count() == 6


# ---- risk ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def daily(spark):
    days = [(s, at(f"2024-01-{d:02d}"), f(d)) for d in range(1, 31) for s, f in (("SPY", lambda d: 100.0 + d % 5), ("A", lambda d: 50.0 + d % 7))]
    return spark.createDataFrame(days, "symbol string, ts timestamp, close double")


def instruments(spark):
    return spark.createDataFrame([("A", "Alpha", "X", "USD", "Tech", None, None, None)], schemas.INSTRUMENTS)


def test_stock_risk(spark, daily):
    (row,) = risk.stock_risk(daily, instruments(spark), AS_OF, "a").collect()
    assert (row.symbol, row.name, row.benchmark, row.lookback_period, row.date) == ("A", "Alpha", "SPY", "252d", "2024-01-31")
    everyone = {r.symbol: r for r in risk.stock_risk(daily, instruments(spark), AS_OF).collect()}
    assert everyone["A"].beta == pytest.approx(row.beta) and everyone["SPY"].beta == pytest.approx(1.0)
    assert everyone["SPY"].name is None
    earlier = risk.stock_risk(daily, instruments(spark), AS_OF, "A", day="2024-01-15").first()
    assert earlier.date == "2024-01-15" and earlier.vol_30d != row.vol_30d
    with pytest.raises(ValueError):
        risk.stock_risk(daily, instruments(spark), AS_OF, benchmark=" ")
    with pytest.raises(ValueError):
        risk.stock_risk(daily, instruments(spark), AS_OF, lookback="5h")


def test_risk_from_the_summary_alone(spark):
    df = summaries(spark, ("A", {"latest_volatility": 0.25}), ("B", {}))
    (row,) = risk.stock_risk_from_summary(df, instruments(spark), AS_OF, "a", day="2024-01-15").collect()
    assert (row.vol_30d, row.vol_60d, row.vol_90d, row.beta, row.var_95, row.name, row.date) == (0.25, 0.25, 0.25, None, None, "Alpha", "2024-01-15")


def test_volatility_reports(spark, daily):
    metrics = spark.createDataFrame(
        [("A", at("2024-01-29"), 0.2), ("A", at("2024-01-30"), 0.3), ("A", at("2023-01-01"), 9.0), ("B", at("2023-01-01"), 9.0)],
        "symbol string, ts timestamp, volatility double",
    )
    (row,) = risk.stock_volatility(metrics, instruments(spark), AS_OF).collect()
    assert row.periods == {"30d": 0.3, "60d": 0.3, "90d": 0.3} and (row.end_date, row.name) == ("2024-01-31", "Alpha")
    assert risk.stock_volatility(metrics, instruments(spark), AS_OF, periods="2y, 5x").where("symbol = 'B'").first().periods == {"2y": 9.0, "5x": 9.0}
    index = risk.market_index(daily, metrics, instruments(spark), AS_OF, "A").collect()
    assert [(r.symbol, r.periods["30d"]) for r in index] == [("A", 0.3)]
    assert risk.market_index(daily, metrics, instruments(spark), AS_OF, "SPY").count() == 0
    periods = {r.symbol: r for r in risk.period_volatility(daily, AS_OF, "7d,1m").collect()}
    report = {r.symbol: r for r in risk.stock_risk(daily, instruments(spark), AS_OF).collect()}
    assert periods["A"].vol_1m == pytest.approx(report["A"].vol_30d)


def test_dashboard(spark, articles, indicators):
    meta = economy.known_metadata(spark, "2024-01-01 00:00:00")
    boards = dashboard.dashboard(summaries(spark, *((f"S{i:02d}", {}) for i in range(20))), indicators, meta, articles, AS_OF, dashboard.MOBILE)
    assert {k: v.count() for k, v in boards.items()} == {"stocks": 6, "indicators": 3, "news": 3}


def test_risk_distribution(spark):
    df = summaries(spark, ("A", {"latest_risk_score": 80.0, "price_change_today": 1.0}), ("B", {"price_change_today": -1.0}), ("C", {"price_change_today": -2.0}))
    assert rows(stocks.risk_distribution(df)) == [("high", "up", 1), ("low", "down", 2)]
