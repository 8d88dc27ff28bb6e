import json
import os

from helpers import at, rows, times
from pyspark.sql import functions as F

from tapewright.operators.quality import quality_rate, valid_counts
from tapewright.operators.rejects import accepted, rejected
from tapewright.sources import landing

RECEIVED = at("2024-01-31 00:00:00")


def payloads(spark, *bodies, **columns):
    data = [
        {"payload": b if isinstance(b, str) else json.dumps(b), "received_at": RECEIVED, **columns, **extra}
        for b, extra in bodies
    ]
    names = ["symbol", "series_id", "category", "interval", "payload", "received_at"]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], landing.PAYLOADS)


def quotes(spark, *bodies):
    df = payloads(spark, *((b, {"symbol": f"S{i}"}) for i, b in enumerate(bodies)))
    return {r.symbol: r for r in times(landing.quotes_to_candles(df), "ts").collect()}


def test_quotes(spark):
    full = {"c": 71.5, "h": 73.0, "l": 69.0, "o": 70.0, "pc": 68.25, "t": 1672617600, "d": 3.25, "dp": 4.76}
    got = quotes(
        spark, full, {}, {**full, "c": 0}, {**full, "o": 0, "h": 0, "l": None}, {**full, "h": 71.0}, {**full, "l": 72.0},
        {**full, "h": 1.0}, {**full, "t": 0}, {**full, "t": 1672617600000}, "not json", {**full, "unknown": 1},
    )
    one = got["S0"]
    assert (one.open, one.high, one.low, one.close, one.volume, one.ts) == (70.0, 73.0, 69.0, 71.5, 0, "2023-01-02 00:00:00")
    assert (one.previous_close, one.vendor_change, one.vendor_change_percent) == (68.25, 3.25, 4.76)
    assert (got["S3"].open, got["S3"].high, got["S3"].low, got["S3"].reason) == (71.5, 71.5, 71.5, None)
    assert got["S7"].ts == "2024-01-31 00:00:00"
    assert [got[f"S{i}"].reason for i in range(11)] == [
        None, "no_price", "no_price", None, "high_below_close", "low_above_close", "high_below_low", None,
        "time_not_in_seconds", "unreadable", None,
    ]


def test_quotes_in_market_hours_only(spark):
    body = {"c": 1.0, "t": 1704466800}  # a Friday, 15:00 UTC
    night = {"c": 1.0, "t": 1704434400}
    df = payloads(spark, (body, {"symbol": "A"}), (night, {"symbol": "B"}))
    assert rows(landing.quotes_to_candles(df, market_hours_only=True), "symbol") == [("A",)]


def test_news_array(spark):
    item = {"category": "general", "datetime": 1672617600, "headline": "H", "id": 778899, "related": "QQX", "source": "Wire",
            "summary": "S", "url": "http://x"}
    bare = {"headline": "H2", "summary": "S2", "url": "https://y"}
    df = payloads(spark, ([item, bare, {**item, "url": "ftp://z"}], {}), ([], {}), ("[{broken", {}), category="forex")
    out = times(landing.news_items(df), "datetime").collect()
    by = {r.headline: r for r in out if r.reason is None}
    assert len(out) == 4
    assert (by["H"].category, by["H"].id, by["H"].source, by["H"].topic_key, by["H"].datetime) == (
        "general", 778899, "Wire", "QQX", "2023-01-02 00:00:00",
    )
    assert (by["H2"].category, by["H2"].source, by["H2"].topic_key, by["H2"].datetime) == (
        "forex", "Finnhub", "forex", "2024-01-31 00:00:00",
    )
    assert by["H2"].id == 1706659200000
    assert sorted(r.reason for r in out if r.reason) == ["unreadable", "url_not_http"]


def test_series_keep_every_observation(spark):
    observations = [{"date": f"2023-12-{d:02d}", "value": str(d), "realtime_start": "2024-01-01"} for d in range(1, 15)]
    gaps = [{"date": None, "value": "1"}, {"date": "2023-12-31"}]
    df = payloads(
        spark, ({"observations": observations}, {"series_id": "VIXCLS"}), ({"observations": gaps}, {"series_id": "GAPS"}),
        ("oops", {"series_id": "BAD"}), ({"observations": []}, {"series_id": "NONE"}),
    )
    out = landing.series_observations(df)
    kept = [r for r in accepted(out).collect()]
    assert sorted(r.observationDate for r in kept) == [f"2023-12-{d:02d}" for d in range(1, 15)]
    assert {(r.realTimeStart, r.realTimeEnd) for r in kept} == {("2024-01-01", "")}
    assert rows(out.where("reason is not null"), "seriesId", "reason") == [
        ("BAD", "unreadable"), ("GAPS", "missing_date"), ("GAPS", "missing_value"), ("NONE", "no_observations"),
    ]
    assert rows(out.where("reason in ('unreadable', 'no_observations')"), "payload") == [("oops",), ('{"observations": []}',)]


def bar(o, h, lo, c, v="100"):
    return {"1. open": o, "2. high": h, "3. low": lo, "4. close": c, "5. volume": v}


def test_daily_bars(spark):
    series = {
        "2024-01-02": bar("1", "2", "0.5", "1.5"),
        "2024-07-02": bar("1", "2", "0.5", "1.5", "x"),
        "2024-01-03": bar("3", "2", "0.5", "1.5"),
        "2024-01-04": bar("1", "2", "1.2", "1.5"),
        "2024-01-05": bar("abc", "2", "0.5", "1.5"),
        "yesterday": bar("1", "2", "0.5", "1.5"),
    }
    df = payloads(spark, ({"Meta Data": {"5. Time Zone": "Nowhere/X"}, "Time Series (Daily)": series}, {"symbol": "A"}))
    out = times(landing.daily_bars(df), "ts")
    assert rows(accepted(out), "symbol", "ts", "close", "volume", "origin") == [
        ("A", "2024-01-02 05:00:00", 1.5, 100, "daily"), ("A", "2024-07-02 04:00:00", 1.5, 0, "daily"),
    ]
    assert sorted(r.reason for r in out.collect() if r.reason) == [
        "bad_time", "high_below_price", "low_above_price", "price_not_positive",
    ]


def test_response_gate(spark):
    bodies = {
        "A": {"Note": "Our API call frequency is 25 a day"},
        "B": {"Information": "Thank you for using"},
        "C": {"Error Message": "Invalid API call"},
        "D": {"Information": "Daily prices", "Time Series (Daily)": {"2024-01-02": bar("1", "2", "0.5", "1.5")}},
        "E": {"Note": "This is a Premium endpoint"},
        "F": {"Information": "the demo API key is for demo purposes"},
        "G": {"Note": "harmless"},
    }
    df = payloads(spark, *((b, {"symbol": s}) for s, b in bodies.items()), ("{", {"symbol": "H"}))
    assert rows(landing.daily_bars(df), "symbol", "reason") == [
        ("A", "call_limit_note"), ("B", "vendor_notice"), ("C", "vendor_error"), ("D", None), ("E", "call_limit_note"),
        ("F", "vendor_notice"), ("G", "no_series"), ("H", "unreadable"),
    ]


def test_intraday_interval_picks_the_map(spark):
    body = {
        "Meta Data": {"6. Time Zone": "UTC"},
        "Time Series (5min)": {"2024-01-02 09:35:00": bar("1", "2", "0.5", "1.5")},
        "Time Series (60min)": {"2024-01-02 10:00:00": bar("2", "3", "1", "2.5")},
    }
    df = payloads(spark, *((body, {"symbol": i or "none", "interval": i}) for i in ("5min", "60min", "1min", "2min", None)))
    bars = landing.intraday_bars(df)
    assert rows(bars.where("reason is not null"), "symbol", "reason") == [
        ("1min", "no_series"), ("2min", "unknown_interval"), ("none", "unknown_interval"),
    ]
    assert json.loads(bars.where("symbol = '2min'").first().payload) == body
    assert rows(times(bars.where("reason is null"), "ts"), "symbol", "ts", "close", "origin") == [
        ("5min", "2024-01-02 09:35:00", 1.5, "intraday_5min"), ("60min", "2024-01-02 10:00:00", 2.5, "intraday_60min"),
    ]


def test_union_keeps_duplicates_and_origin(spark):
    quote = payloads(spark, ({"c": 1.5, "t": 1704171600}, {"symbol": "A"}))
    daily = payloads(spark, ({"Time Series (Daily)": {"2024-01-02": bar("1", "2", "0.5", "1.5")}}, {"symbol": "A"}))
    merged = accepted(landing.merge_candles(landing.quotes_to_candles(quote), landing.daily_bars(daily)))
    assert rows(times(merged, "ts"), "symbol", "ts", "origin") == [
        ("A", "2024-01-02 05:00:00", "daily"), ("A", "2024-01-02 05:00:00", "quote"),
    ]


def test_dead_letters_and_quality(spark):
    df = payloads(spark, ({"c": 1.0}, {"symbol": "A"}), ({"c": 0, "pad": "x" * 900}, {"symbol": "B"}), ({"c": 2.0}, {"symbol": "A"}))
    classified = landing.quotes_to_candles(df)
    (letter,) = rejected(classified, "quotes", "quote", F.lit("2024-01-31").cast("timestamp")).collect()
    assert (letter.source, letter.record_type, letter.reason, len(letter.data) > 900) == ("quotes", "quote", "no_price", True)
    rate = quality_rate(classified).first()
    assert (rate.valid_count, rate.invalid_count, round(rate.quality_rate, 2), rate.degraded) == (2, 1, 66.67, True)
    none = quality_rate(classified.where("false")).first()
    assert (none.quality_rate, none.degraded) == (100.0, False)
    assert rows(valid_counts(classified, ["symbol"])) == [("A", 2, 0), ("B", 0, 1)]


def test_payload_files(spark, work):
    line = {"symbol": "A", "payload": json.dumps({"c": 1.0, "t": 1672617600}), "received_at": "2024-01-31T00:00:00Z"}
    with open(f"{work}/a.json", "w") as file:
        file.write(json.dumps(line) + "\n")
    assert rows(accepted(landing.quotes_to_candles(landing.read_payloads(spark, work))), "symbol", "close") == [("A", 1.0)]


def test_raw_body_files(spark, work):
    for symbol, body in {"AAPL": {"c": 1.5, "t": 1672617600}, "007": {"c": 2.5}}.items():
        os.makedirs(f"{work}/symbol={symbol}")
        with open(f"{work}/symbol={symbol}/1.json", "w") as file:
            json.dump(body, file, indent=1)
    bodies = landing.read_bodies(spark, work)
    assert bodies.dtypes == [(f.name, f.dataType.simpleString()) for f in landing.PAYLOADS.fields]
    assert bodies.where("received_at is null").count() == 0
    got = accepted(landing.quotes_to_candles(bodies))
    assert rows(got, "symbol", "close") == [("007", 2.5), ("AAPL", 1.5)]
    os.makedirs(f"{work}/news/category=forex")
    with open(f"{work}/news/category=forex/1.json", "w") as file:
        json.dump([{"headline": "H", "summary": "S", "url": "http://x"}] * 2, file, indent=1)
    items = accepted(landing.news_items(landing.read_bodies(spark, f"{work}/news")))
    assert rows(items, "category", "headline") == [("forex", "H"), ("forex", "H")]
