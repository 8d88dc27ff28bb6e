"""The streams, drained over topics that Spark writes from the supplied tables.

Each query publishes the rows as framed records, runs the pipeline until nothing is left and reads
the tables it wrote. The SQL is that of the batch query.
"""

from datetime import datetime

from pyspark.sql import functions as F

from sql_checks import base, landing
from sql_checks.base import NEGATIVE, POSITIVE, check
from tapewright import schemas
from tapewright.operators.quality import windows_of_minutes
from tapewright.session import shared_folder
from tapewright.sources.store import MarketStore
from tapewright.sources.topics import publish_files, topic_stream, topic_table
from tapewright.streaming import alerts, ingest, monitors, pipelines
from tapewright.streaming.runner import Job, drain

_NTZ = "timestamp_ntz"
# The supplied requests are sparse: any failure within five minutes counts as a high rate.
SPARSE_RATE = 0.003


def _run(spark, name, rows, process=None, path=None, folder=None):
    started = drain(spark, [Job(name, rows, "30 seconds", process, path)], f"{folder}/checkpoints")
    if started.failures:
        raise started.failures[name]
    return started.queries[name]


def candle_records(candles):
    return candles.withColumn("timestamp", F.col("ts").cast("timestamp"))


def stored_candles(spark, folder) -> MarketStore:
    """The candle pipeline over all candles."""
    work = shared_folder(spark, "candles")
    topic = f"{work}/topic"
    publish_files(candle_records(base.candles(spark, folder)), schemas.CANDLE_TOPIC, "symbol", topic)
    store = MarketStore(spark, f"{work}/store")
    rows = pipelines.classified_candles(topic_stream(spark, topic, schemas.CANDLE_TOPIC))
    _run(spark, "candles", pipelines.counted(rows, "candle_rows"), pipelines.candle_batch(store), folder=work)
    return store


@check(
    "stream_candles",
    """ SELECT symbol, ts, open, high, low, close, CAST(volume AS DOUBLE) AS volume, volatility, risk AS risk_score,
      change AS price_change, pct AS price_change_percent FROM measured""",
    "measured",
)
def stream_candles(spark, folder):
    store = stored_candles(spark, folder)
    metrics = store.metrics().drop("arrival", "day", "trend_numeric")
    joined = store.candles().drop("arrival", "day").join(metrics, ["symbol", "ts"], "full")
    return joined.withColumn("ts", F.col("ts").cast(_NTZ))


@check(
    "stream_summaries",
    """ SELECT symbol, last_timestamp, current_price, latest_volume, latest_volatility, latest_risk_score, latest_trend,
      price_change_today, price_change_percent_today FROM summaries""",
    "summaries",
)
def stream_summaries(spark, folder):
    rows = stored_candles(spark, folder).stock_summaries().drop("arrival", "calculation_date")
    return rows.withColumn("last_timestamp", F.col("last_timestamp").cast(_NTZ))


@check(
    "stream_news",
    """ SELECT id, headline, sentiment, source, related_symbol, ts, date_bucket FROM news
    WHERE regexp_matches(summary, '[^\t-\r\x1c-\x1f\\p{Z}]')""",
    "news",
)
def stream_news(spark, folder):
    work = shared_folder(spark, "news")
    records = base.articles(spark, folder).select(
        F.lit("general").alias("category"), F.col("ts").cast("timestamp").alias("datetime"), "headline",
        F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("image"), F.col("related_symbol").alias("related"),
        "source", "summary", "url",
    )
    publish_files(records, schemas.NEWS_TOPIC, "category", f"{work}/topic")
    store = MarketStore(spark, f"{work}/store")
    rows = pipelines.classified_news(topic_stream(spark, f"{work}/topic", schemas.NEWS_TOPIC))
    _run(spark, "news", rows, pipelines.news_batch(store, positive=POSITIVE, negative=NEGATIVE), folder=work)
    news = store.news().select("id", "headline", "sentiment", "source", "related_symbol", "ts", "date_bucket")
    return news.withColumn("ts", F.col("ts").cast(_NTZ))


def stored_observations(spark, folder) -> MarketStore:
    """Good observations (one per series and date) and all bad ones through the economic pipeline."""
    work = shared_folder(spark, "economic")
    columns = ("series_id", "observation_date", "value")
    good = base.observations(spark, folder).withColumn("value", F.col("value").cast("string")).select(*columns)
    bad = base.economic(spark, folder).where(F.col("value").isin(".", "n/a")).select(*columns)
    records = good.unionByName(bad).select(
        F.col("series_id").alias("seriesId"), F.col("observation_date").alias("observationDate"), "value",
        F.lit("").alias("realTimeStart"), F.lit("").alias("realTimeEnd"),
    )
    publish_files(records, schemas.OBSERVATION_TOPIC, "seriesId", f"{work}/topic")
    store = MarketStore(spark, f"{work}/store")
    rows = pipelines.classified_observations(topic_stream(spark, f"{work}/topic", schemas.OBSERVATION_TOPIC))
    _run(spark, "observations", rows, pipelines.observation_batch(store), folder=work)
    return store


@check("stream_economic", " SELECT series_id, ts, value FROM observations", "observations")
def stream_economic(spark, folder):
    rows = stored_observations(spark, folder).observations().select("series_id", "ts", "value")
    return rows.withColumn("ts", F.col("ts").cast(_NTZ))


@check(
    "stream_dead_letters",
    """ SELECT 'economic-observations' AS source, 'observation' AS record_type,
      CASE raw_value WHEN '.' THEN 'no_observation' ELSE 'value_not_a_number' END AS reason, count(*) AS n
    FROM economic WHERE raw_value IN ('.', 'n/a') GROUP BY 3""",
    "economic",
)
def stream_dead_letters(spark, folder):
    rejects = stored_observations(spark, folder).rejects()
    return rejects.groupBy("source", "record_type", "reason").agg(F.count(F.lit(1)).alias("n"))


_CLOSED = """
      SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' AS window_end,
        round(avg(CASE WHEN volatility > 0 THEN (volatility + 1 - volatility) / volatility ELSE 0 END), 9) AS volatility
      FROM ticks GROUP BY 1, 2"""


@check("stream_volatility_15m", _CLOSED, "ticks")
def stream_volatility_15m(spark, folder):
    """Every event as a candle one unit high; windows the watermark has closed, and the last ones from the log."""
    work = shared_folder(spark, "volatility")
    value = F.col("volatility")
    candles = base.ticks(spark, folder).select(
        "symbol", F.col("ts").cast("timestamp").alias("ts"), value.alias("open"), (value + 1).alias("high"),
        value.alias("low"), value.alias("close"), F.lit(1).cast("bigint").alias("volume"), F.lit(None).cast("string").alias("reason"),
    )
    candles.write.parquet(f"{work}/candles")
    stream = spark.readStream.schema(candles.schema).parquet(f"{work}/candles")
    _run(spark, "volatility", monitors.volatility_windows(stream), path=f"{work}/windows", folder=work)
    windows = monitors.complete_windows(spark.read.parquet(f"{work}/windows"), spark.read.parquet(f"{work}/candles"))
    rows = base.rounded(windows, "volatility", digits=9)
    return rows.withColumn("window_end", F.col("window_end").cast(_NTZ))


@check("stream_unique_candles", " SELECT symbol, ts, close FROM candles", "candles")
def stream_unique_candles(spark, folder):
    """Every candle delivered twice, passed on once."""
    work = shared_folder(spark, "unique")
    candles = base.candles(spark, folder).select(
        "symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume",
        F.lit(None).cast("string").alias("reason"),
    )
    candles.unionByName(candles).write.parquet(f"{work}/candles")
    stream = spark.readStream.schema(candles.schema).parquet(f"{work}/candles")
    _run(spark, "unique", monitors.unique_candles(stream), path=f"{work}/out", folder=work)
    return spark.read.parquet(f"{work}/out").select("symbol", F.col("ts").cast(_NTZ).alias("ts"), "close")


@check(
    "stream_reject_rates",
    """
    SELECT service AS source, minute + to_minutes(k) AS window_end, sum(n)::BIGINT AS rejects, sum(n) / 300.0::DOUBLE AS rate
    FROM (SELECT 'requests' AS service, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM requests WHERE NOT ok GROUP BY 2),
      (SELECT unnest([1, 2, 3, 4, 5]) AS k)
    GROUP BY 1, 2""",
    "requests",
)
def stream_reject_rates(spark, folder):
    work = shared_folder(spark, "rejects")
    rows = base.requests(spark, folder).select(
        F.col("ts").cast("timestamp").alias("ingest_time"), F.when(F.col("ok") == 0, "failed").alias("reason")
    )
    rows.write.parquet(f"{work}/requests")
    stream = spark.readStream.schema(rows.schema).parquet(f"{work}/requests")
    _run(spark, "rates", monitors.rejection_counts(stream, "requests"), path=f"{work}/minutes", folder=work)
    letters = spark.read.parquet(f"{work}/requests").where(F.col("reason").isNotNull())
    letters = letters.select(F.lit("requests").alias("source"), F.col("ingest_time").alias("rejected_at"))
    minutes = monitors.complete_counts(spark.read.parquet(f"{work}/minutes"), letters)
    return windows_of_minutes(minutes).withColumn("window_end", F.col("window_end").cast(_NTZ))


@check(
    "stream_rate_alerts",
    f""" SELECT source, window_end, rejects, rejects / 300.0::DOUBLE AS rate FROM (SELECT *, count(*) OVER (PARTITION BY source ORDER BY window_end
        RANGE BETWEEN INTERVAL 4 MINUTES PRECEDING AND CURRENT ROW) AS held FROM (
      SELECT 'requests' AS source, minute + to_minutes(k) AS window_end, sum(n)::BIGINT AS rejects
      FROM (SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM requests WHERE NOT ok GROUP BY 1), (SELECT unnest([1, 2, 3, 4, 5]) AS k)
      GROUP BY 2) WHERE rejects / 300.0 > {SPARSE_RATE}) WHERE held >= 5""",
    "requests",
)
def stream_rate_alerts(spark, folder):
    """The alert as a stream over the requests' failures, and the windows that the watermark still holds open at the end."""
    work = shared_folder(spark, "alerts")
    rows = base.requests(spark, folder).select(
        F.col("ts").cast("timestamp").alias("ingest_time"), F.when(F.col("ok") == 0, "failed").alias("reason")
    )
    rows.write.parquet(f"{work}/requests")
    stream = spark.readStream.schema(rows.schema).parquet(f"{work}/requests")
    _run(spark, "alerts", alerts.live_alerts(stream, "requests", SPARSE_RATE), path=f"{work}/windows", folder=work)
    letters = spark.read.parquet(f"{work}/requests").where(F.col("reason").isNotNull())
    letters = letters.select(F.lit("requests").alias("source"), F.col("ingest_time").alias("rejected_at"))
    windows = alerts.complete_windows(spark.read.parquet(f"{work}/windows"), letters, SPARSE_RATE)
    return alerts.fired(windows).withColumn("window_end", F.col("window_end").cast(_NTZ))


@check(
    "ingest_quotes",
    f" SELECT symbol, ts, open, high, low, close FROM ({landing._QUOTE}) WHERE {landing._QUOTE_REASON} IS NULL",
    "candles",
)
def ingest_quotes(spark, folder):
    """Landed quotes to the candle topic, and the topic through the candle pipeline."""
    work = shared_folder(spark, "quotes")
    landing.quote_payloads(spark, folder).write.json(f"{work}/landed")
    store = MarketStore(spark, f"{work}/store")
    payloads = spark.readStream.schema("symbol string, payload string, received_at timestamp").json(f"{work}/landed")
    _run(spark, "quotes", payloads, ingest.quote_ingest(ingest.to_folder(f"{work}/topics"), store), folder=work)
    topic = topic_stream(spark, f"{work}/topics/{schemas.CANDLE_TOPIC}", schemas.CANDLE_TOPIC)
    _run(spark, "candles", pipelines.classified_candles(topic), pipelines.candle_batch(store), folder=work)
    return store.candles().select("symbol", F.col("ts").cast(_NTZ).alias("ts"), "open", "high", "low", "close")


@check("ingest_series", " SELECT series_id, ts, value FROM observations", "observations")
def ingest_series(spark, folder):
    """Landed series responses of all observations of a series and month, and the topic through the economic pipeline."""
    work = shared_folder(spark, "series")
    row = F.struct(F.col("observation_date").alias("date"), F.col("value").cast("string").alias("value"))
    months = base.observations(spark, folder).groupBy("series_id", F.date_trunc("month", "ts").alias("month"))
    bodies = months.agg(F.to_json(F.struct(F.collect_list(row).alias("observations"))).alias("payload"))
    bodies.select("series_id", "payload", F.lit(landing.RECEIVED).cast("timestamp").alias("received_at")).write.json(f"{work}/landed")
    store = MarketStore(spark, f"{work}/store")
    payloads = spark.readStream.schema("series_id string, payload string, received_at timestamp").json(f"{work}/landed")
    _run(spark, "series", payloads, ingest.series_ingest(ingest.to_folder(f"{work}/topics"), store), folder=work)
    topic = topic_stream(spark, f"{work}/topics/{schemas.OBSERVATION_TOPIC}", schemas.OBSERVATION_TOPIC)
    _run(spark, "observations", pipelines.classified_observations(topic), pipelines.observation_batch(store), folder=work)
    return store.observations().select("series_id", F.col("ts").cast(_NTZ).alias("ts"), "value")


@check(
    "ingest_bars",
    f"""
    SELECT symbol, ts, close FROM ({landing._DAILY}) WHERE reason IS NULL
    UNION ALL SELECT symbol, ts, arg_max(close, volume) FROM (
      SELECT printf('INT%04d', user_id) AS symbol, date_trunc('second', ts) AS ts, value AS close, event_id AS volume
      FROM events WHERE event_type <> 'purchase' AND value > 0) GROUP BY 1, 2""",
    "candles",
)
def ingest_bars(spark, folder):
    """Daily and intraday responses in one batch to the candle topic, and the topic through the candle pipeline."""
    work = shared_folder(spark, "bars")
    symbol = F.concat(F.lit("INT"), F.substring("symbol", 4, 20)).alias("symbol")
    intraday = landing.intraday_payloads(spark, folder)
    # Given in the order of their numbers, so that the last of one second is the last write.
    number = F.regexp_extract("payload", '5. volume":"([0-9]+)', 1).cast("long")
    intraday = intraday.orderBy(number).select(symbol, "interval", "payload", "received_at")
    daily = landing.daily_payloads(spark, folder).withColumn("interval", F.lit(None).cast("string"))
    store = MarketStore(spark, f"{work}/store")
    process = ingest.bar_ingest(ingest.to_folder(f"{work}/topics"), store)
    process(daily.unionByName(intraday), 0)
    topic = topic_stream(spark, f"{work}/topics/{schemas.CANDLE_TOPIC}", schemas.CANDLE_TOPIC)
    _run(spark, "candles", pipelines.classified_candles(topic), pipelines.candle_batch(store), folder=work)
    return store.candles().select("symbol", F.col("ts").cast(_NTZ).alias("ts"), "close")


@check(
    "stream_rewrites",
    " SELECT symbol, ts, close + 2 AS close FROM candles",
    "candles",
)
def stream_rewrites(spark, folder):
    """Every candle written three times: twice in one published batch, and again in the next; the last write counts."""
    work = shared_folder(spark, "rewrites")
    records = candle_records(base.candles(spark, folder))
    first, second, third = (
        records.withColumns({c: F.col(c) + n for c in ("open", "high", "low", "close")}) for n in (5, 1, 2)
    )
    publish_files(first.unionByName(second), schemas.CANDLE_TOPIC, "symbol", f"{work}/topic", 0)
    publish_files(third, schemas.CANDLE_TOPIC, "symbol", f"{work}/topic", 1)
    store = MarketStore(spark, f"{work}/store")
    rows = pipelines.classified_candles(topic_stream(spark, f"{work}/topic", schemas.CANDLE_TOPIC))
    _run(spark, "candles", rows, pipelines.candle_batch(store), folder=work)
    return store.candles().select("symbol", F.col("ts").cast(_NTZ).alias("ts"), "close")


@check(
    "metadata_replayed",
    """ SELECT series_id, 'Daily' AS frequency, CAST(min(observation_date) || ' 00:00:00' AS TIMESTAMP) AS last_updated FROM (
      SELECT CASE event_id % 3 WHEN 0 THEN 'VIXCLS' WHEN 1 THEN 'SP500' ELSE upper(event_type) END AS series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS observation_date
      FROM events WHERE value IS NOT NULL) WHERE series_id IN ('VIXCLS', 'SP500') GROUP BY 1""",
)
def metadata_replayed(spark, folder):
    """Batches of known and unknown series, a week each and every one processed on two days: a known series is stored once, as of the first batch that has it."""
    work = shared_folder(spark, "metadata")
    number = F.col("event_id") % 3
    series = F.when(number == 0, "VIXCLS").when(number == 1, "SP500").otherwise(F.upper("event_type"))
    records = base.table(spark, folder, "events").where(F.col("value").isNotNull()).select(
        series.alias("seriesId"), F.to_date("ts").cast("string").alias("observationDate"), F.col("value").cast("string").alias("value"),
        F.lit("").alias("realTimeStart"), F.lit("").alias("realTimeEnd"),
    )
    store = MarketStore(spark, f"{work}/store")
    for batch in range(4):
        week = records.where((F.dayofmonth(F.col("observationDate").cast("date")) / 8).cast("int") == batch)
        publish_files(week, schemas.OBSERVATION_TOPIC, "seriesId", f"{work}/topic", batch)
        # A batch reads what it was delivered, not the whole topic; delivered on the day it tells of.
        topic = topic_table(spark, f"{work}/topic/main-{batch}", schemas.OBSERVATION_TOPIC)
        rows = pipelines.classified_observations(topic.withColumn("timestamp", F.col("record.observationDate").cast("timestamp")))
        for day in (30, 31):
            pipelines.observation_batch(store, datetime(2024, 1, day))(rows, batch)
    return store.indicator_metadata().select("series_id", "frequency", F.col("last_updated").cast(_NTZ).alias("last_updated"))


@check(
    "stream_indicators",
    " SELECT indicator, latest_value, observation_date FROM indicators",
    "indicators",
)
def stream_indicators(spark, folder):
    return stored_observations(spark, folder).indicator_summaries().select("indicator", "latest_value", "observation_date")


@check(
    "dead_letter_contents",
    """ SELECT 'economic-observations' AS source, '{"seriesId":"' || series_id || '","observationDate":"' || observation_date
      || '","value":"' || raw_value || '","realTimeStart":"","realTimeEnd":""}' AS data
    FROM economic WHERE raw_value IN ('.', 'n/a')""",
    "economic",
)
def dead_letter_contents(spark, folder):
    """Whole refused records, as they can be published again."""
    return stored_observations(spark, folder).rejects().select("source", "data")


@check("ingest_news", " SELECT id, headline, sentiment FROM news WHERE regexp_matches(summary, '[^\t-\r\x1c-\x1f\\p{Z}]')", "news")
def ingest_news(spark, folder):
    """Landed news responses to the news topic, and the topic through the news pipeline."""
    work = shared_folder(spark, "landed-news")
    item = F.struct(
        F.unix_timestamp("ts").alias("datetime"), "headline", F.col("doc_id").alias("id"), F.col("related_symbol").alias("related"),
        "source", "summary", "url",
    )
    body = F.to_json(F.array(item)).alias("payload")
    landed = base.articles(spark, folder).select(F.col("lang").alias("category"), body, F.lit(landing.RECEIVED).cast("timestamp").alias("received_at"))
    landed.write.parquet(f"{work}/landed")
    store = MarketStore(spark, f"{work}/store")
    payloads = spark.readStream.schema(landed.schema).parquet(f"{work}/landed")
    _run(spark, "landed", payloads, ingest.news_ingest(ingest.to_folder(f"{work}/topics"), store), folder=work)
    topic = topic_stream(spark, f"{work}/topics/{schemas.NEWS_TOPIC}", schemas.NEWS_TOPIC)
    _run(spark, "news", pipelines.classified_news(topic), pipelines.news_batch(store, positive=POSITIVE, negative=NEGATIVE), folder=work)
    return store.news().select("id", "headline", "sentiment")
