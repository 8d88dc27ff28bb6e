"""Tables that change in place: bucketed latest tables, packed logs, rollups under correction, pages of an index."""

from pyspark.sql import functions as F

from sql_checks import base
from sql_checks.base import AS_OF, check
from tapewright.functions.measures import with_measures
from tapewright.operators import pages, points, rollups
from tapewright.operators.latest import latest_per_key
from tapewright.plans.stocks import summary_rows
from tapewright.session import shared_folder
from tapewright.sources.store import MarketStore, arrival, utc_day

_NTZ = "timestamp_ntz"
_SUMMARY = "symbol, ts AS last_timestamp, close AS current_price, volume AS latest_volume, risk AS latest_risk_score"


@check(
    "latest_in_batches",
    f"""
    SELECT 'newest' AS version, {_SUMMARY} FROM measured QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1
    UNION ALL SELECT * FROM (SELECT 'before batch 2' AS version, {_SUMMARY} FROM measured WHERE day(ts) < 16
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)""",
    "measured",
)
def latest_in_batches(spark, folder):
    """Summaries merged batch by batch, out of order and with a replay; the newest version beside an earlier one."""
    store = MarketStore(spark, shared_folder(spark, "latest"))
    candles = base.candles(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    for batch, weeks in enumerate(((1,), (0,), (3,), (3,), (2,))):
        rows = candles.where((F.dayofmonth("ts") / 8).cast("int").isin(*weeks)).withColumn("arrival", arrival(batch, F.lit(0)))
        newest = with_measures(latest_per_key(rows, ["symbol"], ["ts", "arrival"]), AS_OF)
        for _ in range(2):
            store.upsert_latest("stock_summaries", summary_rows(newest, "arrival"), batch)
    columns = ["symbol", F.col("last_timestamp").cast(_NTZ).alias("last_timestamp"), "current_price", "latest_volume", "latest_risk_score"]
    whole = store.latest("stock_summaries").select(F.lit("newest").alias("version"), *columns)
    return whole.unionByName(store.latest("stock_summaries", 2).select(F.lit("before batch 2").alias("version"), *columns))


_PARTS = 9


@check(
    "packed_candles",
    f"""
    SELECT symbol, ts, batch_id, CASE WHEN batch_id = 3 THEN close + 1 ELSE close END AS close
    FROM (SELECT *, CAST(substr(symbol, 4) AS BIGINT) % {_PARTS} AS batch_id FROM candles)
    UNION ALL SELECT symbol, ts, {_PARTS} AS batch_id, close FROM candles WHERE CAST(substr(symbol, 4) AS BIGINT) % {_PARTS} = 5""",
    "candles",
)
def packed_candles(spark, folder):
    """The whole log after its days were packed, a packed batch was written again with other prices, and what nobody reads was removed."""
    store = MarketStore(spark, shared_folder(spark, "packed"))
    part = (F.substring("symbol", 4, 20).cast("long") % _PARTS).alias("part")
    candles = base.candles(spark, folder).withColumns({"ts": F.col("ts").cast("timestamp"), "volume": F.col("volume").cast("double"), "part": part})

    def write(batch, rows):
        store.append("candles", rows.withColumn("arrival", arrival(batch, F.lit(0).cast("bigint"))), batch, utc_day("ts"))

    for batch in range(_PARTS):
        write(batch, candles.where(F.col("part") == batch))
    store.pack("candles", least=_PARTS // 2)
    write(3, candles.where("part = 3").withColumn("close", F.col("close") + 1))
    write(_PARTS, candles.where("part = 5"))
    store.drop_packed("candles", keep=1)
    store.pack("candles", least=1)
    return store.log("candles").select("symbol", F.col("ts").cast(_NTZ).alias("ts"), "batch_id", "close")


_CORRECTED = """
    corrected AS (SELECT printf('SYM%04d', user_id) AS symbol, ts, event_id, value + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS price
      FROM events WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id % 7 = 0 DESC, event_id DESC) = 1)"""


def rolled_up(spark, folder) -> MarketStore:
    """Every event as a candle one unit high, then every seventh corrected, late and in a batch of its own."""
    store = MarketStore(spark, shared_folder(spark, "rollups"))
    events = base.table(spark, folder, "events").where(F.col("value") > 0)
    for batch, chosen in enumerate((events, events.where("event_id % 7 = 0"))):
        price = F.col("value") + batch
        rows = chosen.select(
            base.symbol_of("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), price.alias("open"), (price + 1).alias("high"),
            price.alias("low"), price.alias("close"), F.lit(1.0).alias("volume"), arrival(batch, F.col("event_id")).alias("arrival"),
        )
        store.append("candles", rows, batch, utc_day("ts"))
        rollups.refresh(store, None, batch)
    return store


@check(
    "rollup_resample",
    f""" WITH {_CORRECTED}
    SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, min_by(price, ts) AS open, max(price) + 1 AS high, min(price) AS low,
      max_by(price, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, round(avg((price + 1 - price) / price), 9) AS volatility
    FROM corrected GROUP BY 1, 2""",
)
def rollup_resample(spark, folder):
    """Hourly candles from the 15-minute states."""
    rows = rollups.resampled(rolled_up(spark, folder).rollups("rollup_15m"), "1 hour")
    return base.rounded(rows, "volatility", digits=9).withColumn("ts", F.col("ts").cast(_NTZ))


@check(
    "rollup_volatility",
    f""" WITH {_CORRECTED}
    SELECT window_end, round(avg(v), 9) AS volatility FROM (
      SELECT symbol, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, avg((price + 1 - price) / price) AS v FROM corrected GROUP BY 1, 2)
    GROUP BY 1""",
)
def rollup_volatility(spark, folder):
    """The market's mean volatility per day from the daily states."""
    means = rollups.window_means(rolled_up(spark, folder).rollups("rollup_1d"), "1 day")
    rows = base.rounded(points.market_mean(means, "volatility"), "volatility", digits=9)
    return rows.withColumn("window_end", F.col("window_end").cast(_NTZ))


_CHANGES = ("price_change_percent_today DESC NULLS LAST", "symbol")


@check(
    "stock_page_indexed",
    """ SELECT symbol, pct AS price_change_percent_today, 3 AS page, count(*) OVER () AS total_elements
    FROM (SELECT symbol, price_change_percent_today AS pct FROM summaries) ORDER BY pct DESC NULLS LAST, symbol LIMIT 10 OFFSET 30""",
    "summaries",
)
def stock_page_indexed(spark, folder):
    """The fourth page of summaries by today's change."""
    path = shared_folder(spark, "pages")
    pages.write_index(base.summaries(spark, folder), _CHANGES, path, bucket_rows=16)
    return pages.read_page(spark, path, _CHANGES, 3, 10).select("symbol", "price_change_percent_today", "page", "total_elements")


@check("tick_page_indexed", " SELECT symbol, ts, event_id, volatility FROM (SELECT printf('SYM%04d', user_id) AS symbol, ts, event_id, value AS volatility"
       " FROM events) ORDER BY ts, event_id LIMIT 50 OFFSET 4000")
def tick_page_indexed(spark, folder):
    """A deep page of all ticks by time."""
    path, order = shared_folder(spark, "pages"), ("ts", "event_id")
    ticks = base.table(spark, folder, "events").select(base.symbol_of("user_id").alias("symbol"), "ts", "event_id", F.col("value").alias("volatility"))
    pages.write_index(ticks, order, path, bucket_rows=1000)
    return pages.read_page(spark, path, order, 80, 50).select("symbol", "ts", "event_id", "volatility")
