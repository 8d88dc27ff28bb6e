"""The candle, news and economic pipelines.

Each is a stateless stream (decode, classify, count) whose batches are written set-wise: one cached
classified frame feeds every table, nothing is collected. The logs are complete before any stateful
query sees the rows, so late data is never lost from them.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.functions.checks import candle_reason, news_reason
from tapewright.functions.measures import stored_metrics, with_measures
from tapewright.functions.text import NEGATIVE_TERMS, POSITIVE_TERMS, news_id, sentiment
from tapewright.operators.latest import latest_per_key
from tapewright.operators.rejects import rejected
from tapewright.plans.economy import known_metadata, latest_indicators, missing_metadata, parse_observations
from tapewright.plans.stocks import summary_rows
from tapewright.sources.store import MarketStore, arrival, news_day, utc_day
from tapewright.sources.topics import decode_topic

log = logging.getLogger(__name__)

BatchFunction = Callable[[DataFrame, int], None]


class SinkFailure(RuntimeError):
    """Some tables of a batch could not be written; the batch will be replayed."""


def write_all(name: str, batch_id: int, sinks: dict[str, Callable[[], None]]) -> None:
    """Write every sink; one that fails does not keep the others from being written.

    A failure is raised at the end, so the checkpoint stays and the batch is replayed. Replaying
    replaces what the other sinks wrote.
    """
    failures: dict[str, Exception] = {}
    for sink, write in sinks.items():
        try:
            write()
        except Exception as error:  # noqa: BLE001 - any sink error must leave the others running
            log.exception("%s batch %s: sink %s failed", name, batch_id, sink)
            failures[sink] = error
    if failures:
        raise SinkFailure(f"{name} batch {batch_id}: {', '.join(failures)}") from next(iter(failures.values()))


def counted(classified: DataFrame, name: str) -> DataFrame:
    """Row counts of every batch, reported in the query's progress; costs no extra job."""
    return classified.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    )


def _classified(decoded: DataFrame, reason: Column) -> DataFrame:
    """Decoded rows with a reason; only those refused keep their whole record, for nobody else reads it and a batch is kept while its sinks do."""
    judged = decoded.withColumn("reason", reason)
    return judged.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))


def cached_batches(first_batch: int = 0) -> Callable[[BatchFunction], BatchFunction]:
    """Keep a batch while several sinks read it; skip it when empty.

    Batches are numbered from `first_batch`. A stream that starts over with a new checkpoint counts
    from zero again, so it is given `store.next_batch(...)`, lest it replace the batches stored before.
    """

    def wrap(process: BatchFunction) -> BatchFunction:
        def run(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                if not batch.isEmpty():
                    process(batch, first_batch + batch_id)
            finally:
                batch.unpersist()

        return run

    return wrap


def _good(batch: DataFrame, batch_id: int) -> DataFrame:
    """Accepted rows with their arrival: the batch, then the order in which its rows were written to the topic.

    A part's rows follow those of the parts before it; there are as many parts as the batch has written partitions, and only
    their sizes are added up. Rows stay where they are.
    """
    parts = batch.where(F.col("source_part").isNotNull()).groupBy("source_part").agg((F.max("source_offset") + 1).alias("__rows"))
    earlier = Window.orderBy("source_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source_part", F.sum("__rows").over(earlier).alias("__before"))
    rows = batch.where(F.col("reason").isNull()).join(parts, "source_part", "left")
    place = F.coalesce("__before", F.lit(0)) + F.col("source_offset")
    return rows.withColumn("arrival", arrival(batch_id, place)).drop("__before", "source_part")


def _write_rejects(store: MarketStore, batch: DataFrame, batch_id: int, topic: str, record_type: str) -> None:
    rows = rejected(batch, topic, record_type, F.col("ingest_time"), "raw")
    store.append("rejects", rows, batch_id, utc_day("rejected_at"), writer=topic)


# ---- candles -----------------------------------------------------------------------------------


def classified_candles(records: DataFrame) -> DataFrame:
    """Topic rows to candles with a reason; batch or stream."""
    decoded = decode_topic(records, schemas.CANDLE_TOPIC).withColumnRenamed("timestamp", "ts")
    return _classified(decoded, F.coalesce("reason", candle_reason()))


def candle_batch(store: MarketStore, as_of: datetime | None = None, first_batch: int = 0) -> BatchFunction:
    """Writes one batch of classified candles: log, measures, summaries, dead letters."""

    @cached_batches(first_batch)
    def process(batch: DataFrame, batch_id: int) -> None:
        now = as_of or datetime.now(UTC).replace(tzinfo=None)
        good = _good(batch, batch_id).select(
            "symbol", "ts", "open", "high", "low", "close", "volume", "arrival"
        )
        measured = with_measures(good, now)
        # Only the newest candle of each symbol goes on to the summary table, and only it is measured for it.
        newest = with_measures(latest_per_key(good, ["symbol"], ["ts", "arrival"]), now)
        candles = good.withColumn("volume", F.col("volume").cast("double"))
        write_all(
            "candles",
            batch_id,
            {
                "candles": lambda: store.append("candles", candles, batch_id, utc_day("ts")),
                "metrics": lambda: store.append("metrics", stored_metrics(measured, "arrival"), batch_id, utc_day("ts")),
                "stock_summaries": lambda: store.upsert_latest("stock_summaries", summary_rows(newest, "arrival"), batch_id),
                "rejects": lambda: _write_rejects(store, batch, batch_id, schemas.CANDLE_TOPIC, "candle"),
            },
        )

    return process


# ---- news --------------------------------------------------------------------------------------


def classified_news(records: DataFrame) -> DataFrame:
    decoded = decode_topic(records, schemas.NEWS_TOPIC)
    return _classified(decoded, F.coalesce("reason", news_reason()))


def news_rows(
    good: DataFrame,
    *keep: str,
    positive: Sequence[str] = POSITIVE_TERMS,
    negative: Sequence[str] = NEGATIVE_TERMS,
) -> DataFrame:
    """Accepted news records in the layout of the news table."""
    c = F.col
    return good.select(
        news_id(c("headline"), c("url")).alias("id"),
        c("datetime").alias("ts"),
        "headline",
        "summary",
        sentiment(c("headline"), c("summary"), positive, negative).alias("sentiment"),
        F.coalesce("source", F.lit("Unknown")).alias("source"),
        c("related").alias("related_symbol"),
        *keep,
    )


def news_batch(store: MarketStore, first_batch: int = 0, **lexicon: Sequence[str]) -> BatchFunction:
    @cached_batches(first_batch)
    def process(batch: DataFrame, batch_id: int) -> None:
        good = _good(batch, batch_id)
        rows = news_rows(good, "arrival", **lexicon)
        write_all(
            "news",
            batch_id,
            {
                "news": lambda: store.append("news", rows, batch_id, news_day("ts")),
                "rejects": lambda: _write_rejects(store, batch, batch_id, schemas.NEWS_TOPIC, "news"),
            },
        )

    return process


# ---- economic observations ---------------------------------------------------------------------


def classified_observations(records: DataFrame) -> DataFrame:
    decoded = decode_topic(records, schemas.OBSERVATION_TOPIC).withColumnRenamed("reason", "decode_reason")
    named = decoded.withColumnsRenamed({"seriesId": "series_id", "observationDate": "observation_date"})
    return _classified(parse_observations(named), F.coalesce("decode_reason", "reason")).drop("decode_reason")


def observation_batch(store: MarketStore, as_of: datetime | None = None, first_batch: int = 0) -> BatchFunction:
    @cached_batches(first_batch)
    def process(batch: DataFrame, batch_id: int) -> None:
        now = as_of or datetime.now(UTC).replace(tzinfo=None)
        good = _good(batch, batch_id)
        summaries = latest_indicators(good.withColumn("processed_at", F.col("ingest_time")))
        known = known_metadata(store.spark, now)
        missing = missing_metadata(good, known, store.indicator_metadata(before_batch=batch_id))
        # Stamped by the records, so that a replay on another day writes the same day's folder.
        seen = good.groupBy("series_id").agg(F.min("ingest_time").alias("last_updated"))
        missing = missing.drop("last_updated").join(seen, "series_id")
        write_all(
            "observations",
            batch_id,
            {
                "observations": lambda: store.append("observations", good, batch_id, utc_day("ts")),
                "indicator_summaries": lambda: store.upsert_latest("indicator_summaries", summaries, batch_id),
                "indicator_metadata": lambda: store.append("indicator_metadata", missing, batch_id, utc_day("last_updated")),
                "rejects": lambda: _write_rejects(store, batch, batch_id, schemas.OBSERVATION_TOPIC, "observation"),
            },
        )

    return process
