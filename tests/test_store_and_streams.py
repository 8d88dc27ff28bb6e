import json
import os

import pytest
from helpers import at, plan, rows, times
from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.operators.quality import windows_of_minutes
from tapewright.operators.rejects import shown
from tapewright.plans.stocks import summarise
from tapewright.sources import topics
from tapewright.sources.store import MarketStore, arrival, utc_day
from tapewright.streaming import ingest, monitors, pipelines, runner
from tapewright.streaming.runner import Job

AS_OF = at("2024-01-31 00:00:00")
OHLCV = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume long"


def records(spark, *data):
    """(symbol, time, close) as candles two wide."""
    return in_slices(spark, *data).coalesce(1)


def in_slices(spark, *data):
    full = [(s, at(t), c, c + 1, c - 1, c, 10) for s, t, c in ((s, t, float(c)) for s, t, c in data)]
    return spark.createDataFrame(full, OHLCV)


def publish(spark, path, batch, *data):
    topics.publish_files(records(spark, *data), schemas.CANDLE_TOPIC, "symbol", path, batch)


def run_candles(spark, work, process=None, name="candles"):
    store = MarketStore(spark, f"{work}/store")
    stream = pipelines.counted(pipelines.classified_candles(topics.topic_stream(spark, f"{work}/topic", schemas.CANDLE_TOPIC, 1)), "candle_rows")
    started = runner.drain(spark, [Job(name, stream, "30 seconds", process or pipelines.candle_batch(store, AS_OF))], f"{work}/cp")
    return store, started.queries[name]


def stored(store):
    return rows(times(store.candles(), "ts"), "symbol", "ts", "close")


def test_repeats_corrections_and_late_candles(spark, work):
    topic = f"{work}/topic"
    publish(spark, topic, 0, ("A", "2024-01-30 10:00:00", 10.0), ("B", "2024-01-30 10:00:00", 20.0), ("A", "2024-01-30 12:00:00", 11.0))
    publish(spark, topic, 1, ("A", "2024-01-30 10:00:00", 10.0), ("B", "2024-01-30 10:00:00", 21.0), ("A", "2024-01-30 09:00:00", 9.0))
    store, query = run_candles(spark, work)
    assert stored(store) == [
        ("A", "2024-01-30 09:00:00", 9.0), ("A", "2024-01-30 10:00:00", 10.0), ("A", "2024-01-30 12:00:00", 11.0),
        ("B", "2024-01-30 10:00:00", 21.0),
    ]
    assert store.log("candles").count() == 6  # the log keeps everything
    # The late candle of A does not replace the newer one; the correction of B counts.
    assert rows(store.stock_summaries(), "symbol", "current_price", "calculation_date") == [("A", 11.0, "2024-01-31"), ("B", 21.0, "2024-01-31")]
    assert [(m["rows"], m["accepted"]) for m in runner.batch_counts(query, "candle_rows") if m["rows"]] == [(3, 3), (3, 3)]


def test_stream_equals_batch_and_restarts(spark, work):
    topic = f"{work}/topic"
    publish(spark, topic, 0, *((s, f"2024-01-{d:02d} 10:00:00", d + i) for d in range(1, 11) for i, s in enumerate("ABC", 5)))
    store, _ = run_candles(spark, work)
    before = stored(store)
    publish(spark, topic, 1, *((s, f"2024-01-{d:02d} 10:00:00", d + i) for d in range(11, 21) for i, s in enumerate("ABC", 5)))
    store, _ = run_candles(spark, work)  # same checkpoint: only the new file is read
    assert len(before) == 30 and len(stored(store)) == 60
    assert sorted({r.batch_id for r in store.log("candles").select("batch_id").distinct().collect()}) == [0, 1]
    batch = summarise(store.candles(), AS_OF).drop("calculation_date")
    assert rows(store.stock_summaries().select(batch.columns)) == rows(batch)


def test_rejects_go_to_the_dead_letters(spark, work):
    nan, time = float("nan"), at("2024-01-30 10:00:00")
    good = ("A", 1.0, 2.0, 0.5, 1.5, 10, time)
    data = [good, None, ("", *good[1:]), ("B" * 700, 1.0, 2.0, 0.5, nan, 10, time), ("C", 1.0, 0.1, 0.5, 1.5, 10, time), ("D", *good[1:6], None)]
    full = [("k", r, "t", "w", 0, 0, i, AS_OF) for i, r in enumerate(data)]
    spark.createDataFrame(full, schemas.topic_rows(schemas.CANDLE_WIRE)).coalesce(1).write.parquet(f"{work}/topic/x")
    store, query = run_candles(spark, work)
    assert rows(store.rejects(), "source", "record_type", "reason") == [
        ("candles", "candle", r) for r in ("blank_symbol", "high_below_low", "missing_price", "missing_time", "null_value")
    ]
    assert store.candles().count() == 1
    # The whole record is kept, however long; people see its beginning.
    letter = store.rejects().where("reason = 'missing_price'")
    assert json.loads(letter.first().data.replace("NaN", "0"))["symbol"] == "B" * 700
    assert len(shown(letter).first().data) == 500
    assert runner.batch_counts(query, "candle_rows")[0]["rejected"] == 5


def test_framed_records_ask_for_the_avro_package(spark):
    framed = spark.createDataFrame([(b"k", b"\x00", "t", 0, 0, AS_OF)], "key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
    with pytest.raises(RuntimeError, match="spark-avro"):
        topics.decode_topic(framed, schemas.CANDLE_TOPIC)
    with pytest.raises(RuntimeError, match="spark-avro"):
        topics.encode_topic(records(spark, ("A", "2024-01-30 10:00:00", 1.0)), schemas.CANDLE_TOPIC, "symbol")


def test_the_last_write_of_a_key_counts(spark, work):
    """Also within a batch, over several input partitions, from another writer, and when a batch is published again."""
    data = [(s, "2024-01-30 10:00:00", p) for p in (1.0, 2.0, 3.0) for s in ("A", "B", "C", "D", "E")]
    topics.publish_files(in_slices(spark, *data), schemas.CANDLE_TOPIC, "symbol", f"{work}/topic", 7)
    topics.publish_files(records(spark, ("A", "2024-01-30 10:00:00", 4.0)), schemas.CANDLE_TOPIC, "symbol", f"{work}/topic", 0, "other")
    publish(spark, f"{work}/topic", 8, ("B", "2024-01-30 10:00:00", 5.0))
    publish(spark, f"{work}/topic", 8, ("B", "2024-01-30 10:00:00", 6.0))
    table = topics.topic_table(spark, f"{work}/topic", schemas.CANDLE_TOPIC)
    assert table.count() == 15 + 1 + 1 and table.select("partition").distinct().count() > 3
    last = topics.decode_topic(table, schemas.CANDLE_TOPIC).groupBy("symbol").agg(F.max_by("close", F.struct("source_part", "source_offset")).alias("close"))
    assert rows(last, "symbol", "close") == [("A", 4.0), ("B", 6.0), ("C", 3.0), ("D", 3.0), ("E", 3.0)]
    store = MarketStore(spark, f"{work}/store")
    pipelines.candle_batch(store, AS_OF)(pipelines.classified_candles(table), 0)
    assert rows(store.candles(), "symbol", "close") == rows(last, "symbol", "close") == rows(store.stock_summaries(), "symbol", "current_price")


def test_arrivals_beyond_their_order_are_errors(spark):
    with pytest.raises(ValueError):
        arrival(1 << 23, F.lit(0))
    with pytest.raises(Exception, match="beyond the order"):
        spark.range(1).select(arrival(0, F.col("id") + (1 << 40))).collect()


def test_metadata_replayed_after_midnight_is_stored_once(spark, work):
    df = spark.createDataFrame([("VIXCLS", "2024-01-15", "18.75", "", "")], "seriesId string, observationDate string, value string, realTimeStart string, realTimeEnd string")
    topics.publish_files(df, schemas.OBSERVATION_TOPIC, "seriesId", f"{work}/topic")
    batch = pipelines.classified_observations(topics.topic_table(spark, f"{work}/topic", schemas.OBSERVATION_TOPIC))
    store = MarketStore(spark, f"{work}/store")
    for day in ("2024-01-30", "2024-01-31"):
        pipelines.observation_batch(store, at(day))(batch, 0)
    assert store.log("indicator_metadata").count() == 1 and store.indicator_metadata().count() == 1


def test_one_failing_sink_leaves_the_others_and_the_batch_is_replayed(spark, work, monkeypatch):
    publish(spark, f"{work}/topic", 0, ("A", "2024-01-30 10:00:00", 10.0))
    store = MarketStore(spark, f"{work}/store")
    append = store.append

    def broken(table, *args, **kwargs):
        if table == "metrics":
            raise OSError("disk full")
        append(table, *args, **kwargs)

    monkeypatch.setattr(store, "append", broken)
    with pytest.raises(Exception, match="metrics"):
        run_candles(spark, work, pipelines.candle_batch(store, AS_OF))
    assert store.candles().count() == 1 and store.stock_summaries().count() == 1 and store.metrics().count() == 0
    monkeypatch.undo()
    run_candles(spark, work, pipelines.candle_batch(store, AS_OF))
    assert store.metrics().count() == 1 and store.log("candles").count() == 1


def test_replaying_a_batch_changes_nothing(spark, work):
    publish(spark, f"{work}/topic", 0, ("A", "2024-01-30 10:00:00", 10.0), ("B", "2024-01-29 10:00:00", 20.0))
    batch = pipelines.classified_candles(topics.topic_table(spark, f"{work}/topic", schemas.CANDLE_TOPIC))
    store = MarketStore(spark, f"{work}/store")
    process = pipelines.candle_batch(store, AS_OF)
    for _ in range(2):
        process(batch, 0)
    assert store.log("candles").count() == 2 and store.log("metrics").count() == 2 and store.stock_summaries().count() == 2
    process(batch.where("false"), 1)
    assert store.log("candles").count() == 2


def test_a_new_checkpoint_continues_the_batch_numbers(spark, work):
    publish(spark, f"{work}/topic", 0, ("A", "2024-01-30 10:00:00", 10.0))
    batch = pipelines.classified_candles(topics.topic_table(spark, f"{work}/topic", schemas.CANDLE_TOPIC))
    store = MarketStore(spark, f"{work}/store")
    assert store.next_batch() == 0
    pipelines.candle_batch(store, AS_OF)(batch, 4)
    assert store.next_batch("candles", "metrics") == 5
    corrected = batch.withColumn("close", F.lit(10.5))
    pipelines.candle_batch(store, AS_OF, first_batch=5)(corrected, 0)
    assert stored(store) == [("A", "2024-01-30 10:00:00", 10.5)] and store.log("candles").count() == 2
    assert rows(store.stock_summaries(), "current_price") == [(10.5,)]


def test_sizing():
    from tapewright.session import sizing

    assert sizing(0, 8)["spark.sql.shuffle.partitions"] == "16"
    assert sizing(100 * 2**40, 4000)["spark.sql.shuffle.partitions"] == str(100 * 2**40 // 2**27)


def test_summary_versions(spark, work):
    store = MarketStore(spark, work)
    assert store.stock_summaries().count() == 0 and store.candles().count() == 0

    def row(symbol, price, day):
        data = [(symbol, at(f"2024-01-{day:02d}"), price, 1, 0.0, 0.0, "NEUTRAL", "2024-01-31", 0.0, 0.0, 0)]
        return spark.createDataFrame(data, schemas.STOCK_SUMMARIES)

    store.upsert_latest("stock_summaries", row("A", 1.0, 1), 0)
    store.upsert_latest("stock_summaries", row("B", 2.0, 1), 1)
    store.upsert_latest("stock_summaries", row("A", 3.0, 2), 2)
    store.upsert_latest("stock_summaries", row("B", 9.0, 1), 1)  # a replay of batch 1 does not undo batch 2
    assert rows(store.stock_summaries(), "symbol", "current_price") == [("A", 3.0), ("B", 2.0)]
    store.drop_old_versions("stock_summaries", 1)
    assert store._versions("stock_summaries") == [2]
    assert store.stock_summaries().count() == 2
    # A version that was never finished is passed over.
    store.upsert_latest("stock_summaries", row("A", 99.0, 9), 3)
    os.remove(f"{work}/stock_summaries/manifest/version=3/_SUCCESS")
    assert rows(store.stock_summaries(), "symbol", "current_price") == [("A", 3.0), ("B", 2.0)]


def summary(spark, *data):
    full = [(s, at(f"2024-01-{d:02d}"), float(p), 1, 0.0, 0.0, "NEUTRAL", "2024-01-31", 0.0, 0.0, 0) for s, p, d in data]
    return spark.createDataFrame(full, schemas.STOCK_SUMMARIES)


def files_below(path):
    return {os.path.join(folder, n) for folder, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_a_batch_writes_only_the_buckets_of_its_keys(spark, work):
    store, names = MarketStore(spark, work), [f"S{i}" for i in range(400)]
    store.upsert_latest("stock_summaries", summary(spark, *((n, 1, 1) for n in names)), 0)
    before = files_below(f"{work}/stock_summaries/files")
    assert len(before) > 50
    reader = store.stock_summaries()
    store.upsert_latest("stock_summaries", summary(spark, ("S7", 2, 2), ("S8", 3, 2), ("NEW", 4, 2)), 1)
    added = files_below(f"{work}/stock_summaries/files") - before
    assert 1 <= len(added) <= 3 and before <= files_below(f"{work}/stock_summaries/files")
    changed = {"S7": 2.0, "S8": 3.0, "NEW": 4.0}
    assert rows(store.stock_summaries(), "symbol", "current_price") == sorted((n, changed.get(n, 1.0)) for n in [*names, "NEW"])
    assert reader.count() == 400 and reader.where("current_price > 1").count() == 0  # it stays with its version
    first = store._manifest("stock_summaries")
    store.upsert_latest("stock_summaries", summary(spark, ("S7", 2, 2), ("S8", 3, 2), ("NEW", 4, 2)), 1)
    assert store._manifest("stock_summaries") == first
    store.upsert_latest("stock_summaries", summary(spark).where("false"), 2)
    store.drop_old_versions("stock_summaries", 1)
    left = files_below(f"{work}/stock_summaries/files")
    assert len(left) == len(before | added) - len(added) + len({f.split("bucket=")[1].split("/")[0] for f in added} - {f.split("bucket=")[1].split("/")[0] for f in before})
    assert store.stock_summaries().count() == 401


def candle_rows(spark, batch, *data):
    named = records(spark, *data).withColumnRenamed("timestamp", "ts").withColumn("volume", F.col("volume").cast("double"))
    return named.withColumn("arrival", arrival(batch, F.monotonically_increasing_id()))


def test_packed_days_hold_the_same_rows(spark, work):
    """Before and after, for a reader under way, for a batch that is written again, and when packed once more."""
    store = MarketStore(spark, work)

    def write(batch, writer="main", price=0.0):
        data = [(s, f"2024-01-{d:02d} 10:{batch:02d}:00", price + batch + d) for s in "BA" for d in (1, 2)]
        store.append("candles", candle_rows(spark, batch, *data), batch, utc_day("ts"), writer)

    everything = lambda: rows(store.log("candles").drop("arrival"))
    for batch in range(6):
        write(batch)
        write(batch, "other", 100.0)
    assert store.pack("candles", least=20) == []
    before, reader = everything(), store.log("candles")
    assert store.pack("candles", least=5) == ["2024-01-01", "2024-01-02"]
    assert everything() == before and rows(reader.drop("arrival")) == before and len(before) == 48
    from datetime import date

    day = store.log("candles", date(2024, 1, 2), date(2024, 1, 2))
    assert day.count() == 24 and len(day.inputFiles()) == 3  # one packed file, and the newest batch of either writer
    packed = files_below(f"{work}/candles.packed")
    assert len(packed) == 2
    write(3, price=50.0)  # a replay with other prices
    again = everything()
    assert len(again) == 48 and [r for r in again if r not in before] == rows(store.log("candles").where("batch_id = 3 AND writer = 'main'").drop("arrival"))
    store.drop_packed("candles", keep=1)
    assert everything() == again and len(store.log("candles").inputFiles()) == 2 + 4 + 2
    for batch in (6, 7):
        write(batch)
    newest = everything()
    assert store.pack("candles", least=2) == ["2024-01-01", "2024-01-02"] and everything() == newest
    store.drop_packed("candles", keep=2)
    assert everything() == newest
    store.drop_packed("candles", keep=1)
    assert everything() == newest and not packed & files_below(f"{work}/candles.packed")
    assert store.next_batch("candles") == 8


def test_a_pack_that_did_not_finish_changes_nothing(spark, work):
    store = MarketStore(spark, work)
    for batch in range(3):
        store.append("candles", candle_rows(spark, batch, ("A", f"2024-01-01 10:0{batch}:00", 1.0)), batch, utc_day("ts"))
    store.pack("candles", least=1)
    os.remove(f"{work}/candles.manifest/version=0/_SUCCESS")
    assert store.log("candles").count() == 3
    assert store.pack("candles", least=1) == ["2024-01-01"] and store.log("candles").count() == 3


def test_stored_days_are_pruned(spark, work):
    from tapewright.plans.stocks import _in_range

    store = MarketStore(spark, work)
    df = records(spark, *(("A", f"2024-01-{d:02d} 10:00:00", d) for d in range(1, 31))).withColumnRenamed("timestamp", "ts")
    store.append("candles", df.withColumn("arrival", arrival(0, F.lit(0))), 0, utc_day("ts"))
    found = _in_range(store.candles(), "A", "2024-01-10 12:00:00", 24)
    assert rows(found, "close") == [(10.0,)]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in text and "EqualTo(symbol,A)" in text
    from datetime import date

    span = store.candles(date(2024, 1, 9), date(2024, 1, 10))
    assert rows(span, "close") == [(10.0,), (9.0,)] and len(span.inputFiles()) == 2
    assert store.candles(date(2025, 1, 1)).count() == 0


def test_stored_sides_join_without_another_shuffle(spark, work):
    from tapewright.functions.measures import stored_metrics, with_measures
    from tapewright.operators.points import join_points

    store = MarketStore(spark, work)
    df = records(spark, *(("A", f"2024-01-{d:02d} 10:00:00", d) for d in range(1, 11))).withColumnRenamed("timestamp", "ts")
    df = df.withColumn("arrival", arrival(0, F.lit(0)))
    store.append("candles", df, 0, utc_day("ts"))
    store.append("metrics", stored_metrics(with_measures(df.where("day(ts) > 2"), AS_OF), "arrival"), 0, utc_day("ts"))
    joined = join_points(store.candles(), store.metrics())
    assert joined.count() == 10 and joined.where("volatility is null").count() == 2
    assert plan(joined).count("Exchange hashpartitioning") == 2


def test_files_are_sorted_by_symbol_and_time(spark, work):
    import glob

    import pyarrow.parquet as pq

    df = spark.range(3000).select(
        F.concat(F.lit("S"), (F.xxhash64("id") % 9).cast("string")).alias("symbol"),
        F.timestamp_seconds(1706572800 + F.xxhash64(F.col("id") + 1) % 80000).alias("ts"),
        *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")),
        F.col("id").alias("arrival"),
    )
    MarketStore(spark, work).append("candles", df, 0, utc_day("ts"))
    files = glob.glob(f"{work}/candles/**/*.parquet", recursive=True)
    for name in files:
        columns = pq.ParquetFile(name).read(columns=["symbol", "ts"]).to_pydict()
        keys = list(zip(columns["symbol"], columns["ts"]))
        assert keys == sorted(keys)
    assert files


def test_pipelines_write_dead_letters_side_by_side(spark, work):
    from concurrent.futures import ThreadPoolExecutor

    store = MarketStore(spark, work)
    letters = spark.createDataFrame([("s", "t", "r", at("2024-01-30 10:00:00"), "d")] * 20, schemas.REJECTS)

    def write(writer):
        for batch in range(4):
            store.append("rejects", letters, batch, utc_day("rejected_at"), writer=writer)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, "abcd"))
    assert store.rejects().count() == 4 * 4 * 20


def test_news_pipeline(spark, work):
    news = spark.createDataFrame(
        [("general", at("2024-01-30 10:00:00"), "Stocks rally", 1, None, "AAPL", "Reuters", "on strong growth", "http://a"),
         ("general", at("2024-01-29 10:00:00"), " ", 2, None, None, "Reuters", "text", "http://b")],
        "category string, datetime timestamp, headline string, id long, image string, related string, source string, summary string, url string",
    )
    for batch in (0, 1):  # the same items delivered twice
        topics.publish_files(news, schemas.NEWS_TOPIC, "category", f"{work}/topic", batch)
    store = MarketStore(spark, f"{work}/store")
    stream = pipelines.classified_news(topics.topic_stream(spark, f"{work}/topic", schemas.NEWS_TOPIC, 1))
    runner.drain(spark, [Job("news", stream, "1 minute", pipelines.news_batch(store))], f"{work}/cp")
    (row,) = store.news().collect()
    assert (row.headline, row.sentiment, row.related_symbol, row.date_bucket) == ("Stocks rally", "POSITIVE", "AAPL", "2024-01-30")
    assert store.log("news").count() == 2
    assert rows(store.rejects(), "reason") == [("blank_headline",), ("blank_headline",)]


def test_economic_pipeline(spark, work):
    fields = "seriesId string, observationDate string, value string, realTimeStart string, realTimeEnd string"

    def send(batch, *data):
        df = spark.createDataFrame([(s, d, v, "", "") for s, d, v in data], fields).coalesce(1)
        topics.publish_files(df, schemas.OBSERVATION_TOPIC, "seriesId", f"{work}/topic", batch)

    send(0, ("VIXCLS", "2024-01-15", "18.75"), ("VIXCLS", "2024-01-16", "."), ("NEW", "2024-01-15", "1"), ("VIXCLS", "16/01/2024", "2"))
    send(1, ("VIXCLS", "2024-01-15", "19.00"), ("SP500", "2024-01-14", "4700"), ("VIXCLS", "2024-01-10", "17"))
    store = MarketStore(spark, f"{work}/store")
    stream = pipelines.classified_observations(topics.topic_stream(spark, f"{work}/topic", schemas.OBSERVATION_TOPIC, 1))
    runner.drain(spark, [Job("observations", stream, "5 minutes", pipelines.observation_batch(store, AS_OF))], f"{work}/cp")
    assert rows(times(store.observations(), "ts"), "series_id", "ts", "value") == [
        ("NEW", "2024-01-15 00:00:00", 1.0), ("SP500", "2024-01-14 00:00:00", 4700.0), ("VIXCLS", "2024-01-10 00:00:00", 17.0),
        ("VIXCLS", "2024-01-15 00:00:00", 19.0),
    ]
    assert rows(store.indicator_summaries(), "indicator", "latest_value", "observation_date") == [
        ("NEW", 1.0, "2024-01-15"), ("SP500", 4700.0, "2024-01-14"), ("VIXCLS", 19.0, "2024-01-15"),
    ]
    assert rows(store.indicator_metadata(), "series_id") == [("SP500",), ("VIXCLS",)]  # once each, NEW is unknown
    assert rows(store.rejects(), "reason") == [("bad_date",), ("no_observation",)]


def test_three_pipelines_and_a_query_that_cannot_start(spark, work):
    publish(spark, f"{work}/{schemas.CANDLE_TOPIC}", 0, ("A", "2024-01-30 10:00:00", 10.0))
    for topic in (schemas.NEWS_TOPIC, schemas.OBSERVATION_TOPIC):
        spark.createDataFrame([], schemas.topic_rows(topics.WIRES[topic])).write.parquet(f"{work}/{topic}/empty")
    store = MarketStore(spark, f"{work}/store")
    sources = {t: topics.topic_stream(spark, f"{work}/{t}", t) for t in topics.WIRES}
    jobs = runner.market_jobs(store, sources)
    assert [(j.name, j.pace) for j in jobs] == [("candles", "30 seconds"), ("news", "1 minute"), ("observations", "5 minutes")]
    jobs[1].rows = spark.range(1)  # not a stream
    started = runner.drain(spark, jobs, f"{work}/cp")
    assert set(started.queries) == {"candles", "observations"} and set(started.failures) == {"news"}
    assert store.candles().count() == 1


def test_paced_queries_run_until_stopped(spark, work):
    publish(spark, f"{work}/topic", 0, ("A", "2024-01-30 10:00:00", 10.0))
    store = MarketStore(spark, f"{work}/store")
    rows_ = pipelines.classified_candles(topics.topic_stream(spark, f"{work}/topic", schemas.CANDLE_TOPIC))
    started = runner.start_all(spark, [Job("paced", rows_, "1 second", pipelines.candle_batch(store, AS_OF))], f"{work}/cp")
    query = started.queries["paced"]
    query.processAllAvailable()
    publish(spark, f"{work}/topic", 1, ("B", "2024-01-30 10:00:00", 11.0))
    query.processAllAvailable()
    assert query.isActive and query.name == "paced"
    query.stop()
    assert store.stock_summaries().count() == 2
    with pytest.raises(RuntimeError):
        runner.run(spark, [Job("none", spark.range(1), "1 second")], f"{work}/cp2")


CANDLES = "symbol string, ts timestamp, open double, high double, low double, close double, volume long, reason string, ingest_time timestamp"


def classified(spark, path, name, *data):
    full = [(s, at(t), c, c + 1, c, c, 1, r, at(t)) for s, t, c, r in data]
    spark.createDataFrame(full, CANDLES).coalesce(1).write.parquet(f"{path}/{name}")


def stream_of(spark, path):
    return spark.readStream.schema(CANDLES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_windowed_means_drop_repeats_and_count_late_rows(spark, work):
    path = f"{work}/in"
    classified(spark, path, "1", ("A", "2024-01-30 10:00:00", 1.0, None), ("A", "2024-01-30 10:05:00", 2.0, None), ("B", "2024-01-30 10:05:00", 4.0, "bad"))
    classified(spark, path, "2", ("A", "2024-01-30 10:05:00", 2.0, None), ("A", "2024-01-30 10:07:00", 4.0, None), ("A", "2024-01-30 11:00:00", 1.0, None))
    classified(spark, path, "3", ("A", "2024-01-30 09:00:00", 1.0, None), ("A", "2024-01-30 12:00:00", 1.0, None))
    out = f"{work}/out"
    started = runner.drain(spark, [Job("v", monitors.volatility_windows(stream_of(spark, path)), "1 minute", path=out)], f"{work}/cp")
    got = rows(times(spark.read.parquet(out), "window_end"), "symbol", "window_end", "volatility")
    assert got == [("A", "2024-01-30 10:15:00", pytest.approx((1 + 1 / 2 + 1 / 4) / 3)), ("A", "2024-01-30 11:15:00", 1.0)]
    assert runner.late_rows(started.queries["v"]) == 1


def test_repeats_pass_once_and_corrections_pass(spark, work):
    path = f"{work}/in"
    classified(spark, path, "1", ("A", "2024-01-30 10:00:00", 1.0, None), ("A", "2024-01-30 10:00:00", 1.0, None))
    classified(spark, path, "2", ("A", "2024-01-30 10:00:00", 1.0, None), ("A", "2024-01-30 10:00:00", 1.5, None))
    runner.drain(spark, [Job("u", monitors.unique_candles(stream_of(spark, path)), "1 minute", path=f"{work}/out")], f"{work}/cp")
    assert rows(spark.read.parquet(f"{work}/out"), "close") == [(1.0,), (1.5,)]


def test_rejection_rates(spark, work):
    path = f"{work}/in"
    classified(spark, path, "1", ("A", "2024-01-30 10:00:30", 1.0, "bad"), ("A", "2024-01-30 10:00:40", 1.0, None), ("A", "2024-01-30 11:00:00", 1.0, "bad"))
    runner.drain(spark, [Job("r", monitors.rejection_counts(stream_of(spark, path), "candles"), "1 minute", path=f"{work}/out")], f"{work}/cp")
    closed = spark.read.parquet(f"{work}/out")
    assert rows(closed, "source", "n") == [("candles", 1)]
    letters = spark.read.schema(CANDLES).parquet(f"{path}/1").where("reason is not null")
    whole = monitors.complete_counts(closed, letters.select(F.lit("candles").alias("source"), F.col("ingest_time").alias("rejected_at")))
    assert rows(whole, "source", "n") == [("candles", 1), ("candles", 1)]
    got = windows_of_minutes(whole)
    assert got.count() == 10 and rows(got.select("source", "rejects").distinct()) == [("candles", 1)]


def test_payloads_to_topics(spark, work):
    body = '{"c": 10.0, "t": 1706608800}'
    daily = '{"Meta Data": {"5. Time Zone": "UTC"}, "Time Series (Daily)": {"2024-01-29": {"1. open": "1", "2. high": "2", "3. low": "1", "4. close": "2", "5. volume": "7"}}}'
    hourly = daily.replace("5. Time Zone", "6. Time Zone").replace("(Daily)", "(60min)").replace("2024-01-29", "2024-01-29 10:00:00")
    news = '[{"headline": "H", "summary": "S", "url": "http://x", "datetime": 1706608800}]'
    series = '{"observations": [{"date": "2024-01-15", "value": "18.75"}]}'

    def landed(*data):
        return spark.createDataFrame([(s, i, c, n, p, AS_OF) for s, i, c, n, p in data],
                                     "symbol string, series_id string, category string, interval string, payload string, received_at timestamp")

    store = MarketStore(spark, f"{work}/store")
    publish_ = ingest.to_folder(work)
    ingest.quote_ingest(publish_, store)(landed(("Q", None, None, None, body), ("Z", None, None, None, "{}")), 0)
    ingest.bar_ingest(publish_, store)(landed(("D", None, None, None, daily), ("H", None, None, "60min", hourly)), 0)
    ingest.news_ingest(publish_, store)(landed((None, None, "general", None, news)), 0)
    ingest.series_ingest(publish_, store)(landed((None, "VIXCLS", None, None, series)), 0)
    got = {t: topics.decode_topic(topics.topic_table(spark, f"{work}/{t}", t), t) for t in topics.WIRES}
    assert rows(got[schemas.CANDLE_TOPIC], "symbol", "close", "volume") == [("D", 2.0, 7), ("H", 2.0, 7), ("Q", 10.0, 0)]
    assert rows(got[schemas.NEWS_TOPIC], "headline", "category", "source") == [("H", "general", "Finnhub")]
    assert rows(got[schemas.OBSERVATION_TOPIC], "seriesId", "value") == [("VIXCLS", "18.75")]
    keys = topics.topic_table(spark, f"{work}/{schemas.NEWS_TOPIC}", schemas.NEWS_TOPIC).select(F.col("key").cast("string"))
    assert rows(keys) == [("general",)]
    assert rows(store.rejects(), "source", "reason") == [("quotes", "no_price")]


def test_only_refused_rows_of_a_batch_keep_their_whole_record(spark, work):
    """A good row's record would be spelled out and cached with its batch, for nobody."""
    data = [("SP500", "2024-01-02", "1.5", "", ""), ("SP500", "2024-01-03", ".", "", ""), ("SP500", "2024-13-03", "2", "", "")]
    records = spark.createDataFrame(data, "seriesId string, observationDate string, value string, realTimeStart string, realTimeEnd string")
    topics.publish_files(records, schemas.OBSERVATION_TOPIC, "seriesId", f"{work}/topic")
    found = pipelines.classified_observations(topics.topic_table(spark, f"{work}/topic", schemas.OBSERVATION_TOPIC))
    raw = {r.observation_date: r.raw and json.loads(r.raw)["value"] for r in found.collect()}
    assert raw == {"2024-01-02": None, "2024-01-03": ".", "2024-13-03": "2"}


def test_what_one_task_publishes_can_be_read_by_several(spark, work, monkeypatch):
    monkeypatch.setattr(topics, "FILE_RECORDS", 10)
    data = [("A", "2024-01-30 10:00:00", float(i)) for i in range(1, 36)]
    publish(spark, f"{work}/topic", 0, *data)
    held = topics.topic_table(spark, f"{work}/topic", schemas.CANDLE_TOPIC)
    assert len(held.inputFiles()) == 4 and held.count() == 35
    store, _ = run_candles(spark, work)
    assert stored(store) == [("A", "2024-01-30 10:00:00", 35.0)]  # the order of writes stays
