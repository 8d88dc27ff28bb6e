"""Rollups under correction against raw candles; pages of an index against sorted rows."""

import random
import re
from datetime import timedelta

import pytest
from helpers import at, plan, rows
from pyspark.sql import functions as F

from tapewright.operators import pages, points, rollups
from tapewright.functions.measures import range_volatility
from tapewright.sources.store import MarketStore, arrival, utc_day

START = at("2024-01-30 23:00:00")


def candles(spark, batch, data):
    """(symbol, second, price) as candles one unit high."""
    full = [(s, START + timedelta(seconds=t), p, p + 1, p - 0.25, p + 0.5, 2.0) for s, t, p in data]
    named = spark.createDataFrame(full, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    return named.withColumn("arrival", arrival(batch, F.monotonically_increasing_id()))


def deliver(spark, store, batch, data):
    written = candles(spark, batch, data)
    store.append("candles", written, batch, utc_day("ts"))
    rollups.refresh(store, written.select("symbol", "ts"), batch)


def check(store):
    raw = store.candles()
    for name, every, wide in (("rollup_1m", "1 minute", "5 minutes"), ("rollup_15m", "15 minutes", "30 minutes"), ("rollup_1d", "1 day", "1 day")):
        held = rollups.resampled(store.rollups(name), wide)
        assert rows(held.drop("volatility")) == rows(points.resample(raw, wide))
        own = raw.withColumn("volatility", range_volatility(F.col("high"), F.col("low"), F.col("close")))
        want = rows(points.windowed_mean(own, "volatility", every), "symbol", "window_end", "volatility")
        got = rows(rollups.window_means(store.rollups(name), every), "symbol", "window_end", "volatility")
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_rollups_follow_corrections_late_candles_and_replays(spark, work):
    store, random_ = MarketStore(spark, work), random.Random(1)
    first = [(s, t, float(random_.randint(5, 50))) for s in "ABH" for t in random_.sample(range(7200), 60)]
    deliver(spark, store, 0, first)
    check(store)
    # The highest price of each symbol is corrected downward, others up; some candles are new, one opens a minute earlier.
    top = [max((r for r in first if r[0] == s), key=lambda r: r[2]) for s in "AB"]
    second = [(s, t, 1.0) for s, t, _ in top] + [("H", first[-1][1], 99.0), ("C", 100, 7.0), ("A", 3601, 8.0)]
    deliver(spark, store, 1, second)
    check(store)
    before = rows(store.rollups("rollup_1m"))
    written = store.log("rollup_1m").where("batch_id = 1").count()
    assert written == len({(s, (START + timedelta(seconds=t)).replace(second=0)) for s, t, _ in second})  # dirty windows only
    deliver(spark, store, 1, second)
    assert rows(store.rollups("rollup_1m")) == before
    rollups.refresh(store, store.candles().where("false").select("symbol", "ts"), 2)
    check(store)


def test_rollups_of_packed_logs(spark, work):
    store = MarketStore(spark, work)
    for batch in range(4):
        deliver(spark, store, batch, [("A", 10 * batch, 5.0 + batch), ("A", 0, 9.0 - batch)])
    for name in ("candles", *(n for n, _ in rollups.LEVELS)):
        assert store.pack(name, least=2)
    check(store)
    deliver(spark, store, 4, [("A", 0, 70.0)])
    check(store)
    assert store.rollups("rollup_1d").count() == 1


def test_a_refresh_moves_candles_and_changes_once(spark, work, monkeypatch):
    """Last writes, dirty windows and the states of two widths are all taken where one exchange put the rows."""
    store, moved = MarketStore(spark, work), {}
    append = store.append

    def watched(table, built, *args):
        if table.startswith("rollup"):
            text = re.sub(r"#\d+L?", "", plan(built))
            moved[table] = {re.sub(r", \d+\)$", "", found) for found in re.findall(r"Exchange hashpartitioning\([^)]*\)", text)}
            assert "Join" not in text
        append(table, built, *args)

    monkeypatch.setattr(store, "append", watched)
    deliver(spark, store, 0, [("A", 10, 5.0), ("B", 900, 6.0)])
    assert moved == {name: {"Exchange hashpartitioning(symbol, within"} for name, _ in rollups.LEVELS}
    check(store)


def test_changes_without_a_candle_leave_their_windows_as_they_are(spark, work):
    store = MarketStore(spark, work)
    deliver(spark, store, 0, [("A", 10, 5.0), ("A", 50, 4.0), ("A", 70, 6.0), ("B", 900, 6.0), (None, 10, 3.0)])
    before = {name: rows(store.rollups(name).drop("arrival")) for name, _ in rollups.LEVELS}
    gone = [("A", START), ("A", START + timedelta(seconds=59)), ("A", START + timedelta(seconds=300)), ("Z", START), (None, START)]
    rollups.refresh(store, spark.createDataFrame(gone, "symbol string, ts timestamp"), 1)
    assert {name: rows(store.rollups(name).drop("arrival")) for name, _ in rollups.LEVELS} == before
    assert store.log("rollup_1m").where("batch_id = 1").count() == 1 and store.log("rollup_15m").where("batch_id = 1").count() == 1
    assert all(r.symbol in ("A", "B") for r in store.rollups("rollup_1m").collect())


def test_a_refresh_of_a_batch_reads_nothing_but_its_days_of_the_log(spark, work, monkeypatch):
    """What changed is the batch's own part of the log, and the candles are read once for all widths."""
    store, read = MarketStore(spark, work), []
    log = store.log
    monkeypatch.setattr(store, "log", lambda table, *span: read.append((table, *span)) or log(table, *span))
    day, following = START.date(), (START + timedelta(days=1)).date()
    batches = [
        [("A", 10, 5.0), ("A", 50, 4.0), ("A", 1000, 8.0), ("B", 900, 6.0), (None, 10, 3.0)],
        [("B", 4000, 7.0), ("B", 4010, 9.0)],
        [("A", 50, 1.0), ("C", 4000, 2.0)],
    ]
    spans = [(day, day), (following, following), (day, following)]
    dirty = [[3, 3, 2], [1, 1, 1], [2, 2, 2]]
    for batch, (data, span) in enumerate(zip(batches, spans)):
        store.append("candles", candles(spark, batch, data), batch, utc_day("ts"))
        for _ in range(2):
            read.clear()
            rollups.refresh(store, None, batch)
            assert read == [("candles", *span)]
        assert [store.log(name).where(F.col("batch_id") == batch).count() for name, _ in rollups.LEVELS] == dirty[batch]
    assert all(r.symbol for r in store.rollups("rollup_1m").collect())
    named = store.candles().where("symbol IS NOT NULL")
    monkeypatch.setattr(store, "candles", lambda: named)
    check(store)
    rollups.refresh(store, None, 3)
    assert store.log("rollup_1m").where("batch_id = 3").isEmpty()


def test_days_of_a_batch_in_loose_and_packed_folders(spark, work):
    store = MarketStore(spark, work)
    assert store.batch_days("candles", 0) == []
    day, following = START.date(), (START + timedelta(days=1)).date()
    for batch, seconds in enumerate([(0, 4000), (10,), (20, 4010), (30, 4020)]):
        deliver(spark, store, batch, [("A", s, 5.0 + batch) for s in seconds])
    days = [[day, following], [day], [day, following], [day, following], []]
    assert [store.batch_days("candles", b) for b in range(5)] == days
    assert store.pack("candles", least=2)
    store.drop_packed("candles", keep=1)
    assert [store.batch_days("candles", b) for b in range(5)] == days
    assert store.batch_days("candles", 0, "other") == []
    rollups.refresh(store, None, 0)
    check(store)


ORDER = ("score DESC NULLS LAST", "name")


@pytest.mark.parametrize("bucket_rows", [1, 7, 1000])
def test_pages_of_an_index(spark, work, bucket_rows):
    random_ = random.Random(bucket_rows)
    data = [(f"N{i:03d}", random_.choice([None, 1.5, 2.5, float(i % 13)])) for i in range(90)]
    frame = spark.createDataFrame(data, "name string, score double")
    pages.write_index(frame, ORDER, f"{work}/index", bucket_rows)
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for page, size in ((0, 10), (3, 10), (4, 20), (8, 10), (9, 10), (1, 89), (200, 5), (0, 500)):
        got = pages.read_page(spark, f"{work}/index", ORDER, page, size)
        found = got.collect()
        assert [(r.name, r.score) for r in found] == want[page * size : (page + 1) * size]
        assert all((r.total_elements, r.page, r.has_next) == (90, page, (page + 1) * size < 90) for r in found)
        if bucket_rows == 7 and size == 10:
            assert len(got.inputFiles()) <= 6  # not the skipped ones


def test_pages_of_an_empty_table_and_wrong_terms(spark, work):
    frame = spark.createDataFrame([], "name string, score double")
    pages.write_index(frame, ORDER, f"{work}/index")
    assert pages.read_page(spark, f"{work}/index", ORDER, 0, 10).count() == 0
    with pytest.raises(ValueError):
        pages.write_index(frame, ("score SIDEWAYS",), f"{work}/other")
    with pytest.raises(ValueError):
        pages.read_page(spark, f"{work}/index", ORDER, 0, 0)
