import random

import pytest
from helpers import at, rows, times
from pyspark.sql import functions as F

from tapewright.operators import points, quality, ranking, returns, series
from tapewright.operators.latest import insert_if_absent, latest_by_unique, latest_per_key


def test_latest_row_per_key(spark):
    df = spark.createDataFrame(
        [("A", 1, 1, "old", 1.0), ("A", 2, 1, "new", 2.0), ("A", 2, 2, "newest", 3.0), ("B", None, 9, "untimed", 4.0), ("B", 1, 1, "timed", 5.0)],
        "k string, ts int, seq int, s string, x double",
    )
    assert rows(latest_per_key(df, ["k"], ["ts", "seq"]), "k", "s") == [("A", "newest"), ("B", "timed")]
    assert latest_per_key(df, ["k"], ["ts", "seq"]).columns == df.columns
    unique = df.where("seq = 1").drop("seq")
    assert rows(latest_by_unique(unique, ["k"], "ts"), "k", "s", "x") == [("A", "new", 2.0), ("B", "timed", 5.0)]
    fixed = latest_by_unique(unique.drop("s"), ["k"], "ts")
    assert rows(fixed) == [("A", 2, 2.0), ("B", 1, 5.0)] and fixed.columns == ["k", "ts", "x"]


def test_insert_if_absent(spark):
    existing = spark.createDataFrame([("A", "kept")], "k string, v string")
    new = spark.createDataFrame([("A", "other"), ("B", "new")], "k string, v string")
    assert rows(insert_if_absent(existing, new, "k")) == [("B", "new")]


@pytest.mark.parametrize("n", [3, 1200])
def test_top_per_key_with_a_hot_key(spark, n):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.col("id")
    )
    got = ranking.top_per_key(df, ["k"], [F.desc("id")], n)
    want = {}
    for r in df.collect():
        want.setdefault(r.k, []).append(r.id)
    expected = sorted((k, i) for k, ids in want.items() for i in sorted(ids, reverse=True)[:n])
    assert sorted((r.k, r.id) for r in got.collect()) == expected


def test_pages(spark):
    df = spark.createDataFrame([(s,) for s in "edcba"], "symbol string")

    def page(i, size=2):
        info = ranking.page_info(df, i, size).first()
        found = [r.symbol for r in ranking.page_of(df, ["symbol"], i, size).orderBy("symbol").collect()]
        return found, info.total_elements, info.total_pages, info.has_next, info.has_previous

    assert page(0) == (["a", "b"], 5, 3, True, False)
    assert page(1) == (["c", "d"], 5, 3, True, True)
    assert page(2) == (["e"], 5, 3, False, True)
    assert page(9) == ([], 5, 3, False, True)
    row = ranking.page_of(df, ["symbol"], 1, 2).first()
    assert (row.page, row.size, row.total_elements, row.total_pages, row.has_next, row.has_previous) == (1, 2, 5, 3, True, True)
    empty = ranking.page_info(df.where("false"), 0, 2).first()
    assert (empty.total_elements, empty.total_pages, empty.has_next) == (0, 0, False)
    for bad in ((0, 0), (-1, 2)):
        with pytest.raises(ValueError):
            ranking.page_of(df, ["symbol"], *bad)


@pytest.fixture(scope="module")
def ticks(spark):
    """Irregular series; one symbol holds most rows."""
    rng = random.Random(4)
    data = []
    for symbol, count in (("HOT", 700), ("B", 40), ("C", 1), ("D", 25)):
        seconds = sorted(rng.sample(range(0, 40 * 3600, 7), count))
        data += [(symbol, s, rng.randint(1, 50) * 1.0) for s in seconds]
    df = spark.createDataFrame(data, "symbol string, s long, x double").withColumn("ts", F.timestamp_seconds(1704067200 + F.col("s")))
    return data, df.repartition(5)


def by_symbol(data):
    out = {}
    for symbol, s, x in sorted(data):
        out.setdefault(symbol, []).append((s, x))
    return out


def test_positions_across_buckets(ticks):
    data, df = ticks
    want = sorted((k, s, i) for k, points_ in by_symbol(data).items() for i, (s, _) in enumerate(points_))
    assert rows(series.with_position(df, "symbol", "ts"), "symbol", "s", "position") == sorted(want, key=repr)


@pytest.mark.parametrize("grain", ["minute", "hour", "day", "year"])
@pytest.mark.parametrize("n", [1, 5, 30])
def test_trailing_rows_across_buckets(ticks, grain, n):
    data, df = ticks
    got = series.trailing_rows(
        df, "symbol", "ts", n, {"total": F.sum("x"), "low": F.min("x"), "n": F.count("x")}, grain=grain
    )
    want = []
    for symbol, points_ in by_symbol(data).items():
        for i, (s, _) in enumerate(points_):
            window = [x for _, x in points_[max(0, i - n + 1) : i + 1]]
            want.append((symbol, s, sum(window), min(window), len(window)))
    assert rows(got, "symbol", "s", "total", "low", "n") == sorted(want, key=repr)
    with pytest.raises(ValueError):
        series.trailing_rows(df, "symbol", "ts", 0, {})


def test_pages_of_a_long_series(ticks):
    data, df = ticks
    newest = [s for s, _ in reversed(by_symbol(data)["HOT"])]
    hot = df.where("symbol = 'HOT'")
    for page in (0, 3, 99, 100, 500):
        got = series.page_of_series(hot, "symbol", "ts", page, 7).orderBy(F.desc("ts")).collect()
        assert [r.s for r in got] == newest[page * 7 : page * 7 + 7]
        assert all((r.total_elements, r.total_pages) == (700, 100) for r in got)


def test_pages_of_equal_times_hold_every_row_once(spark):
    df = spark.createDataFrame([("A", at("2024-01-01"), i) for i in range(25)], "symbol string, ts timestamp, s long").repartition(5)
    found = [r.s for page in range(4) for r in series.page_of_series(df, "symbol", "ts", page, 7).collect()]
    assert sorted(found) == list(range(25))


def test_join_of_points(spark):
    prices = spark.createDataFrame(
        [("A", at("2024-01-01"), 1.0, 2.0, 0.5, 1.5, 100.0), ("A", at("2024-01-02"), 1.0, 2.0, 0.5, 1.6, 200.0)],
        "symbol string, ts timestamp, open double, high double, low double, close double, volume double",
    )
    metrics = spark.createDataFrame(
        [("A", at("2024-01-02"), 0.1, 10.0, 0.6, 60.0, 1.0), ("A", at("2024-01-03"), 0.2, 20.0, 0.0, 0.0, 0.0)],
        "symbol string, ts timestamp, volatility double, risk_score double, price_change double, price_change_percent double, trend_numeric double",
    )
    joined = points.metric_point(points.join_points(prices, metrics)).orderBy("ts").collect()
    assert [(r.price, r.volume, r.volatility) for r in joined] == [(1.5, 100, None), (1.6, 200, 0.1), (None, None, 0.2)]
    none = points.join_points(prices.where("false"), metrics.where("false"))
    assert none.count() == 0
    wide = points.pivot_points(points.to_long(metrics, points.METRIC_FIELDS), points.METRIC_FIELDS)
    assert rows(wide.drop("ts")) == rows(metrics.drop("ts"))


def test_resample_and_windows(spark):
    df = spark.createDataFrame(
        [("A", at("2024-01-01 10:00:00"), 1.0, 4.0, 1.0, 2.0, 10.0), ("A", at("2024-01-01 10:04:59"), 2.0, 3.0, 0.5, 2.5, 20.0),
         ("A", at("2024-01-01 10:05:00"), 9.0, 9.0, 9.0, 9.0, 1.0)],
        "symbol string, ts timestamp, open double, high double, low double, close double, volume double",
    )
    got = times(points.resample(df, "5 minutes"), "ts")
    assert [r[1:] if r[0] == "A" else r for r in rows(got)] == [
        (got.orderBy("ts").first().ts, 1.0, 4.0, 0.5, 2.5, 30.0), (got.orderBy(F.desc("ts")).first().ts, 9.0, 9.0, 9.0, 9.0, 1.0),
    ]
    tick = spark.createDataFrame([("A", at("2024-01-01 10:01:00"), 1.0), ("A", at("2024-01-01 10:02:00"), 3.0), ("B", at("2024-01-01 10:03:00"), 8.0)],
                                 "symbol string, ts timestamp, v double")
    means = points.windowed_mean(tick, "v")
    assert rows(means, "symbol", "v") == [("A", 2.0), ("B", 8.0)]
    assert points.market_mean(means, "v").first().v == 5.0  # unweighted over symbols
    assert points.collapsed_mean(means, "v").first().v == 5.0


def test_price_domain(spark):
    df = spark.createDataFrame([("A", 10.0), ("A", 30.0), ("B", 5.0)], "symbol string, close double")
    assert rows(points.price_domain(df)) == [("A", 10.0, 30.0, 9.0, 31.0), ("B", 5.0, 5.0, 5.0, 5.0)]


LOG = "service string, ts timestamp, ok int"


def test_request_stats(spark):
    log = spark.createDataFrame(
        [("a", at("2024-01-30 23:00:00"), 1), ("a", at("2024-01-30 23:59:00"), 1), ("a", at("2024-01-30 23:59:30"), 0), ("b", at("2024-01-30"), 0)], LOG
    )
    got = {r.service: r for r in quality.request_stats(log, "2024-01-31 00:00:00").collect()}
    assert (got["a"].successes, got["a"].failures, round(got["a"].success_rate, 2), got["a"].calls) == (2, 1, 66.67, 3)
    last = log.where("service = 'a' and ok = 1").agg(F.max("ts").alias("t")).select(
        F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - F.unix_timestamp("t")
    ).first()[0]
    assert got["a"].seconds_since_success == last
    assert (got["b"].success_rate, got["b"].seconds_since_success) == (0.0, -1)


def test_quota(spark):
    log = spark.sql("SELECT 'a' AS service, TIMESTAMP '2024-01-30 10:00:00' + make_interval(0,0,0,0,0,0,id) AS ts, 1 AS ok FROM range(26)")
    (row,) = quality.quota_usage(log).collect()
    assert (row.calls, row.remaining, row.quota_reached) == (26, 0, True)
    (row,) = quality.quota_usage(log.limit(24)).collect()
    assert (row.calls, row.remaining, row.quota_reached) == (24, 1, False)
    assert quality.hourly_usage(log).first().calls == 26


def test_alerts_need_five_minutes_running(spark):
    minutes = [(m, 31) for m in (0, 1, 2, 3, 4, 5)] + [(m, 31) for m in (20, 21, 22, 24, 25)] + [(40, 5)]
    df = spark.createDataFrame([("s", m, n / 300) for m, n in minutes], "source string, m int, rate double")
    windows = df.select("source", F.timestamp_seconds(F.col("m") * 60).alias("window_end"), F.lit(31).alias("rejects"), "rate", "m")
    got = quality.rejection_alerts(windows)
    assert rows(got.select((F.unix_seconds("window_end") / 60).cast("int"))) == [(4,), (5,)]


def test_rejection_windows_count_each_letter_in_five_windows(spark):
    df = spark.sql("SELECT 's' AS source, TIMESTAMP '2024-01-01 10:00:30' AS rejected_at UNION ALL SELECT 's', TIMESTAMP '2024-01-01 10:02:10'")
    got = [r.rejects for r in quality.rejection_windows(df).orderBy("window_end").collect()]
    assert got == [1, 1, 2, 2, 2, 1, 1]


def candles(spark, **series_):
    data = [(s, f"2024-01-{d:02d}", float(c)) for s, closes in series_.items() for d, c in closes.items()]
    return spark.createDataFrame(data, "symbol string, day string, close double").select(
        "symbol", F.to_timestamp("day").alias("ts"), "close"
    )


def test_period_texts():
    cases = {"30d,60d,90d": 90, "3m": 90, "1y": 365, "xm": 30, "xd": 30, "7w": 30, " 5D , 2m": 60, "": 30, "d": 30, "y": 365}
    assert {k: returns.period_days(k) for k in cases} == cases
    assert [returns.lookback_days(t) for t in ("252d", "2m", "1y")] == [252, 60, 365]
    for bad in ("5h", "d", "5", "-5d", "5w", "", "5d "):
        with pytest.raises(ValueError):
            returns.lookback_days(bad)


def test_returns_use_the_previous_day_with_data(spark):
    df = candles(spark, A={1: 100, 2: 110, 9: 99})
    got = [(str(r.day), r.ret) for r in returns.daily_returns(df).orderBy("day").collect()]
    assert [d for d, _ in got] == ["2024-01-01", "2024-01-02", "2024-01-09"]
    assert got[0][1] is None and got[1][1] == pytest.approx(0.1) and got[2][1] == pytest.approx(-0.1)


def test_recent_returns_equal_the_tail_of_all_returns(spark):
    rng = random.Random(7)
    sparse = {d: rng.randint(1, 99) for d in rng.sample(range(1, 31), 12)}
    df = candles(spark, A={d: d + 1 for d in range(1, 31)}, B=sparse, C={1: 5, 28: 6})
    full = returns.daily_returns(df).where("ret is not null and day between '2024-01-20' and '2024-01-29'")
    assert rows(returns.recent_returns(df, "2024-01-29", 10)) == rows(full)


def test_returns_within_a_day_use_the_last_close(spark):
    df = spark.createDataFrame(
        [("A", at("2024-01-01 09:00:00"), 1.0), ("A", at("2024-01-01 16:00:00"), 100.0), ("A", at("2024-01-02 10:00:00"), 120.0)],
        "symbol string, ts timestamp, close double",
    )
    assert [r.close for r in returns.daily_closes(df).orderBy("day").collect()] == [100.0, 120.0]


def test_beta_of_the_benchmark_is_one_and_flat_is_null(spark):
    df = candles(spark, BEN={1: 10, 2: 11, 3: 10, 4: 12}, TWICE={1: 10, 2: 12, 3: 9.8181818181818, 4: 13.7454545454545}, LATE={3: 1, 4: 2}, X={1: 1})
    got = {r.symbol: r.beta for r in returns.beta(df, "BEN", "2024-01-31", 60).collect()}
    assert got["BEN"] == pytest.approx(1.0) and got["TWICE"] == pytest.approx(2.0)
    assert got["LATE"] is None and "X" not in got
    flat = candles(spark, BEN={1: 10, 2: 10, 3: 10}, A={1: 1, 2: 2, 3: 1})
    assert {r.beta for r in returns.beta(flat, "BEN", "2024-01-31", 60).collect()} == {None}


def test_tail_risk_against_plain_python(spark):
    rng = random.Random(11)
    closes = {d: rng.uniform(50, 150) for d in range(1, 31)}
    got = returns.tail_risk(candles(spark, A=closes), "2024-01-31", 60).first()
    rets = sorted(closes[d] / closes[d - 1] - 1 for d in range(2, 31))

    def cut(p):
        place = p * (len(rets) - 1)
        low = int(place)
        return rets[low] + (rets[low + 1] - rets[low]) * (place - low)

    for p, var, cvar in ((0.05, got.var_95, got.cvar_95), (0.01, got.var_99, got.cvar_99)):
        tail = [r for r in rets if r <= cut(p)]
        assert var == pytest.approx(-cut(p)) and cvar == pytest.approx(-sum(tail) / len(tail))


def test_risk_figures_agree_with_the_single_operators(spark):
    rng = random.Random(3)
    df = candles(
        spark, BEN={d: rng.uniform(50, 60) for d in range(1, 31)}, A={d: rng.uniform(5, 6) for d in range(3, 29, 2)}, ONE={5: 1}
    )
    got = {r.symbol: r for r in returns.risk_figures(df, "BEN", "2024-01-30", 20).collect()}
    beta = {r.symbol: r.beta for r in returns.beta(df, "BEN", "2024-01-30", 20).collect()}
    tail = {r.symbol: r for r in returns.tail_risk(df, "2024-01-30", 20).collect()}
    vol = {r.symbol: r for r in returns.historical_volatility(returns.daily_returns(df)).where("day <= '2024-01-30'").orderBy("day").collect()}
    for symbol in ("BEN", "A"):
        assert got[symbol].beta == pytest.approx(beta[symbol])
        assert got[symbol].var_95 == pytest.approx(tail[symbol].var_95) and got[symbol].cvar_99 == pytest.approx(tail[symbol].cvar_99)
        assert got[symbol].vol_90d == pytest.approx(vol[symbol].vol_90d)
    assert "ONE" not in got


def test_rolling_volume_and_levels(spark):
    df = spark.createDataFrame(
        [("A", at(f"2024-01-{d:02d}"), d * 10.0, float(d), float(d) / 2) for d in range(1, 26)],
        "symbol string, ts timestamp, volume double, high double, low double",
    )
    average = [r.volume_average for r in returns.volume_average(df).orderBy("ts").collect()]
    assert average[0] == 10.0 and average[24] == sum(range(6, 26)) / 20 * 10
    levels = returns.support_resistance(df).orderBy("ts").collect()[24]
    assert (levels.support, levels.resistance) == (3.0, 25.0)


def test_invariants_on_random_candles(spark):
    from tapewright.functions.measures import with_measures

    rng = random.Random(1)
    data = []
    for i in range(500):
        prices = sorted(rng.uniform(0.01, 300) for _ in range(4))
        open_, close = rng.sample(prices[1:3], 2)
        data.append((f"S{i}", open_, prices[3], prices[0], close, rng.randint(0, 10**9)))
    df = with_measures(spark.createDataFrame(data, "symbol string, open double, high double, low double, close double, volume long"), "2024-01-31")
    sign = {"BULLISH": 1, "BEARISH": -1}
    for r in df.collect():
        assert r.volatility >= 0 and r.risk_score == r.volatility * 100
        assert r.trend == "NEUTRAL" or r.price_change_percent * sign[r.trend] > 1


