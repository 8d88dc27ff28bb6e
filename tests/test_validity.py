from helpers import NAN, at
from pyspark.sql import functions as F

from tapewright.functions import checks
from tapewright.plans.economy import parse_observations

T = at("2024-01-02 10:00:00")
CANDLE = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"


def reasons(spark, schema, rule, data):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(rule).collect()]


def test_every_candle_rule(spark):
    good = ("A", T, 1.0, 2.0, 0.5, 1.5, 10)

    def but(**changes):
        names = ["symbol", "ts", "open", "high", "low", "close", "volume"]
        return tuple(changes.get(n, v) for n, v in zip(names, good))

    data = [
        good, but(symbol=""), but(symbol="\t"), but(symbol=None), but(ts=None), but(close=None), but(close=NAN),
        but(open=0.0), but(low=-1.0), but(high=0.25), but(volume=None), but(volume=0),
    ]
    assert reasons(spark, CANDLE, checks.candle_reason(), data) == [
        None, "blank_symbol", "blank_symbol", "blank_symbol", "missing_time", "missing_price", "missing_price",
        "price_not_positive", "price_not_positive", "high_below_low", "missing_volume", None,
    ]


def test_every_vendor_candle_rule(spark):
    data = [
        ("A", T, 1.0, 2.0, 0.5, 1.5, 1),
        (" ", T, 1.0, 2.0, 0.5, 1.5, 1),
        ("A", None, 1.0, 2.0, 0.5, 1.5, 1),
        ("A", T, 0.0, 2.0, 0.5, 1.5, 1),
        ("A", T, NAN, 2.0, 0.5, 1.5, 1),
        ("A", T, 1.0, 0.4, 0.5, 1.5, 1),
        ("A", T, 3.0, 2.0, 0.5, 1.5, 1),
        ("A", T, 1.0, 2.0, 0.5, 2.5, 1),
        ("A", T, 1.0, 2.0, 1.2, 1.5, 1),
        ("A", T, 1.8, 2.0, 1.6, 1.5, 1),
    ]
    assert reasons(spark, CANDLE, checks.vendor_candle_reason(), data) == [
        None, "blank_symbol", "bad_time", "price_not_positive", "price_not_positive", "high_below_low",
        "high_below_price", "high_below_price", "low_above_price", "low_above_price",
    ]


def test_every_vendor_news_rule(spark):
    schema = "headline string, summary string, url string, datetime long"
    data = [
        ("h" * 1000, "s" * 5000, "http://x", 1640995200),
        ("h" * 1001, "s", "http://x", 1),
        ("h", "s" * 5001, "http://x", 1),
        ("h", " \n", "http://x", 1),
        (None, "s", "http://x", 1),
        ("h", "s", "", 1),
        ("h", "s", "ftp://x", 1),
        ("h", "s", "https://x", 1640995200000),
        ("h", "s", "https://x", None),
    ]
    assert reasons(spark, schema, checks.vendor_news_reason(1000, 5000), data) == [
        None, "headline_too_long", "summary_too_long", "blank_summary", "blank_headline", "blank_url", "url_not_http",
        "time_not_in_seconds", None,
    ]
    assert reasons(spark, schema, checks.vendor_news_reason(), data[:3]) == [None, None, None]  # no limit by default


def test_every_news_rule(spark):
    schema = "headline string, summary string, url string, id long, datetime timestamp"
    data = [
        ("h", "s", "u", 1, T), ("h", "s", "u", 1, None), ("h", "s", "u", None, T), ("h", "s", None, 1, T),
        (" ", "s", "u", 1, T), ("h", None, "u", 1, T),
    ]
    assert reasons(spark, schema, checks.news_reason(), data) == [
        None, "missing_time", "missing_id", "missing_url", "blank_headline", "blank_summary",
    ]


def test_observation_parsing(spark):
    data = [
        ("VIXCLS", "2024-01-15", "18.75"), ("VIXCLS", "2024-01-15", "."), ("VIXCLS", "2024-01-15", "n/a"),
        ("VIXCLS", "2024-01-15", None), ("VIXCLS", "2024-01-15", "1e3"), (" ", "2024-01-15", "1"),
        ("VIXCLS", None, "1"), ("VIXCLS", "2024-13-01", "1"), ("VIXCLS", "15.01.2024", "1"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, series_id string, observation_date string, value string")
    got = [(r.value, r.reason) for r in parse_observations(df).orderBy("i").collect()]
    assert got == [
        (18.75, None), (None, "no_observation"), (None, "value_not_a_number"), (None, "missing_value"), (1000.0, None),
        (1.0, "blank_series"), (1.0, "missing_date"), (1.0, "bad_date"), (1.0, "bad_date"),
    ]
    first = parse_observations(df).where("i = 0").select(F.date_format("ts", "yyyy-MM-dd HH:mm")).first()[0]
    assert first == "2024-01-15 00:00"
