import uuid
from hashlib import md5

from helpers import INF, NAN, times, values
from pyspark.sql import functions as F

from tapewright.functions import measures as M
from tapewright.functions import numbers as N
from tapewright.functions import text as T
from tapewright.functions import times as C

c = F.col
OHLC = "open double, high double, low double, close double"


def measured(spark, *data):
    df = spark.createDataFrame(
        [("S", *row, 100) for row in data], f"symbol string, {OHLC}, volume long"
    )
    return M.with_measures(df, "2024-01-31").collect()


def test_measures_and_trend_limits(spark):
    up, flat, down, still = measured(
        spark, (100.0, 110.0, 90.0, 101.5), (100.0, 110.0, 90.0, 101.0), (100.0, 110.0, 90.0, 98.9), (100.0, 100.0, 100.0, 100.0)
    )
    assert up.volatility == 20 / 101.5 and up.risk_score == up.volatility * 100
    assert up.price_change == 1.5 and up.price_change_percent == 1.5 and up.trend == "BULLISH"
    assert flat.price_change_percent == 1.0 and flat.trend == "NEUTRAL"
    assert down.trend == "BEARISH"
    assert still.volatility == 0.0 and still.trend == "NEUTRAL"
    assert up.volume_average == 100.0 and up.calculation_date == "2024-01-31"


def test_measures_with_nan_compare_as_false(spark):
    (row,) = measured(spark, (100.0, NAN, 90.0, 100.0))
    assert row.volatility == 0.0
    assert values(spark, M.trend(c("p")), "p double", [(NAN,), (None,)]) == ["NEUTRAL", "NEUTRAL"]


def test_zero_open_gives_no_percent(spark):
    (row,) = measured(spark, (0.0, 2.0, 1.0, 1.5))
    assert row.price_change_percent == 0.0


def test_stored_metrics_fill_missing_and_number_the_trend(spark):
    df = spark.createDataFrame(
        [("A", "t", None, None, 1.0, None, "bearish"), ("B", "t", 1.0, 2.0, None, 3.0, "BULLISH"), ("C", "t", 0.0, 0.0, 0.0, 0.0, "?")],
        "symbol string, ts string, volatility double, risk_score double, price_change double, price_change_percent double, trend string",
    )
    out = {r.symbol: r for r in M.stored_metrics(df).collect()}
    assert out["A"].volatility == 0.0 and out["A"].trend_numeric == -1.0
    assert out["B"].price_change == 0.0 and out["B"].trend_numeric == 1.0
    assert out["C"].trend_numeric == 0.0


def test_tiers_and_directions(spark):
    tiers = values(spark, M.risk_tier(c("s")), "s double", [(70.0,), (69.9,), (40.0,), (39.9,), (NAN,), (None,)])
    assert tiers == ["high", "medium", "medium", "low", "low", "low"]
    ways = values(spark, M.direction(c("s")), "s double", [(0.1,), (-0.1,), (0.0,), (NAN,), (None,)])
    assert ways == ["up", "down", "flat", "flat", "flat"]


def test_blank_covers_all_white_space(spark):
    data = [(None,), ("",), (" ",), ("\t\n",), (" ",), (" ",), (" a ",), ("​",), ("\x1f",), (" \u0085",)]
    assert values(spark, T.is_blank(c("s")), "s string", data) == [True] * 6 + [False, False, True, False]


def test_sentiment_counts_distinct_substrings(spark):
    data = [
        ("Stocks rally", "Record High and growth"),  # three positive
        ("Supply", "steady"),  # 'up' inside 'supply' is one hit: no lead of two
        ("gain gain gain", "gain"),  # one term, four times
        ("Shares fall", "amid crisis"),
        ("gain and rise", "fall and drop"),
    ]
    got = values(spark, T.sentiment(c("h"), c("s")), "h string, s string", data)
    assert got == ["POSITIVE", "NEUTRAL", "NEUTRAL", "NEGATIVE", "NEUTRAL"]


def test_news_id_is_a_version_3_uuid_of_the_bytes(spark):
    data = [("Fed holds rates", "http://a.b/c"), ("Ünïcode 株価", "http://x")]
    got = values(spark, T.news_id(c("h"), c("u")), "h string, u string", data)
    assert got[0] == "0f216a54-078c-3de7-93b6-b3a984b1c9a5"
    for (headline, url), value in zip(data, got):
        digest = md5((headline + url).encode()).digest()
        assert value == str(uuid.UUID(bytes=digest, version=3))


def test_text_comparisons(spark):
    data = [("NEGATIVE",), ("negative",), ("other",), (None,)]
    assert values(spark, T.same_text(c("s"), "Negative"), "s string", data) == [True, True, False, False]
    assert values(spark, T.contains_text(c("s"), "GAT"), "s string", data) == [True, True, False, None]
    assert values(spark, T.truncate(c("s"), 3), "s string", data) == ["NEG", "neg", "oth", None]


def test_finite_and_zero_guards(spark):
    data = [(1.0,), (NAN,), (INF,), (-INF,), (None,)]
    assert values(spark, N.is_finite(c("x")), "x double", data) == [True, False, False, False, False]
    assert values(spark, N.above(c("x"), 0), "x double", data) == [True, False, True, False, None]
    texts = [("1.5",), ("1e3",), ("abc",), (None,), ("",)]
    assert values(spark, N.to_double(c("s")), "s string", texts) == [1.5, 1000.0, 0.0, 0.0, 0.0]
    wholes = [("12",), ("+3",), ("1.5",), ("x",), (None,), ("99999999999999999999",)]
    assert values(spark, N.to_long(c("s")), "s string", wholes) == [12, 3, 0, 0, 0, 0]


def test_zone_conversion(spark):
    known = C.known_zones(spark)
    data = [
        ("2024-01-02", "US/Eastern"),
        ("2024-07-02", "US/Eastern"),
        ("2024-01-02", "Nowhere/X"),
        ("2024-01-02", None),
        ("2024-01-02", "Asia/Kolkata"),
        ("2024-01-02", "+02:00"),
        ("2024-02-30", "UTC"),
        ("02/01/2024", "UTC"),
    ]
    instant = C.local_to_utc(c("d"), "yyyy-MM-dd", C.zone_or_default(c("z"), known))
    got = values(spark, F.date_format(instant, "MM-dd HH:mm"), "d string, z string", data)
    assert got == ["01-02 05:00", "07-02 04:00", "01-02 05:00", "01-02 05:00", "01-01 18:30", "01-01 22:00", None, None]


def test_epoch_and_fallback(spark):
    moment = C.epoch_seconds_or(c("t"), F.lit("2024-01-31").cast("timestamp"))
    got = values(spark, F.date_format(moment, "yyyy-MM-dd HH:mm"), "t long", [(1640995200,), (0,), (-5,), (None,)])
    assert got == ["2022-01-01 00:00"] + ["2024-01-31 00:00"] * 3


def test_observation_date_fallbacks(spark):
    data = [("2024-01-15", None), ("bad", "2024-01-10 13:00:00"), ("2024-02-30", "2024-01-10 13:00:00"), (None, None)]
    day = C.observation_date(c("d"), c("t").cast("timestamp"), "2024-01-31 08:00:00")
    got = values(spark, day.cast("string"), "d string, t string", data)
    assert got == ["2024-01-15", "2024-01-10", "2024-01-10", "2024-01-31"]


def test_market_hours(spark):
    # 2024-01-05 is a Friday; the exchange is five hours behind UTC.
    data = [("2024-01-05 14:29:00",), ("2024-01-05 14:30:00",), ("2024-01-05 20:59:00",), ("2024-01-05 21:00:00",), ("2024-01-06 15:00:00",)]
    got = values(spark, C.in_market_hours(c("t").cast("timestamp")), "t string", data)
    assert got == [False, True, True, False, False]


def test_date_bucket_is_the_utc_day(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-02 23:59:59' AS ts")
    assert times(df, "ts").select(C.date_bucket(c("ts"))).first()[0] == "2024-01-02"
