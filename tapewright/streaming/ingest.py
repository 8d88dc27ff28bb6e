"""Landed vendor payloads to topics, with dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.operators.rejects import accepted, rejected
from tapewright.sources import landing
from tapewright.sources.store import MarketStore, utc_day
from tapewright.sources.topics import publish_files, publish_kafka
from tapewright.streaming.pipelines import BatchFunction, cached_batches, write_all

Publish = Callable[[DataFrame, str, str, str, int], None]  # records, topic, key column, writer, batch


def to_folder(root: str) -> Publish:
    """Publish into topic folders below a root."""

    def publish(records: DataFrame, topic: str, key: str, writer: str, batch_id: int) -> None:
        publish_files(records, topic, key, f"{root}/{topic}", batch_id, writer)

    return publish


def to_kafka(servers: str) -> Publish:
    """Publish to a broker. A replayed batch is sent again; readers keep the last arrival per key."""
    return lambda records, topic, key, writer, batch_id: publish_kafka(records, topic, key, servers)


def _ingest(
    name: str, topic: str, key: str, classify: Callable[[DataFrame], DataFrame], rename: dict[str, str],
    publish: Publish, store: MarketStore, first_batch: int,
) -> BatchFunction:
    @cached_batches(first_batch)
    def process(payloads: DataFrame, batch_id: int) -> None:
        classified = classify(payloads)
        records = accepted(classified).withColumnsRenamed(rename)
        # The batch's own time, the same when it is replayed.
        landed = payloads.agg(F.max("received_at")).first()[0] if "received_at" in payloads.columns else None
        bad = rejected(classified, name, topic, F.current_timestamp() if landed is None else F.lit(landed))
        write_all(
            name,
            batch_id,
            {
                topic: lambda: publish(records, topic, key, name, batch_id),
                "rejects": lambda: store.append("rejects", bad, batch_id, utc_day("rejected_at"), writer=name),
            },
        )

    return process


def quote_ingest(
    publish: Publish, store: MarketStore, market_hours_only: bool = False, first_batch: int = 0
) -> BatchFunction:
    """Quotes to keyed candles."""
    return _ingest(
        "quotes",
        schemas.CANDLE_TOPIC,
        "symbol",
        lambda p: landing.quotes_to_candles(p, market_hours_only),
        {"ts": "timestamp"},
        publish,
        store,
        first_batch,
    )


def bar_ingest(publish: Publish, store: MarketStore, first_batch: int = 0) -> BatchFunction:
    """Daily (interval null) and intraday bars to keyed candles, merged into one topic."""

    def classify(payloads: DataFrame) -> DataFrame:
        daily = landing.daily_bars(payloads.where(F.col("interval").isNull()))
        intraday = landing.intraday_bars(payloads.where(F.col("interval").isNotNull()))
        return landing.merge_candles(daily, intraday)

    return _ingest("bars", schemas.CANDLE_TOPIC, "symbol", classify, {"ts": "timestamp"}, publish, store, first_batch)


def news_ingest(publish: Publish, store: MarketStore, first_batch: int = 0) -> BatchFunction:
    """News items keyed by related symbol, else by category."""
    return _ingest("news", schemas.NEWS_TOPIC, "topic_key", landing.news_items, {}, publish, store, first_batch)


def series_ingest(publish: Publish, store: MarketStore, first_batch: int = 0) -> BatchFunction:
    """Economic observations keyed by series."""
    return _ingest("series", schemas.OBSERVATION_TOPIC, "seriesId", landing.series_observations, {}, publish, store, first_batch)
