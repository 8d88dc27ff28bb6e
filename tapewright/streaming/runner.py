"""Starting, pacing and watching the streams."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tapewright import schemas
from tapewright.sources.store import MarketStore
from tapewright.streaming import pipelines
from tapewright.streaming.pipelines import BatchFunction, counted

log = logging.getLogger(__name__)

CANDLE_PACE = "30 seconds"
NEWS_PACE = "1 minute"
ECONOMIC_PACE = "5 minutes"

# State lives in RocksDB below the checkpoint, not on the executors' heaps.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Job:
    """One streaming query: what it reads, what it does with a batch, and its pace."""

    name: str
    rows: DataFrame
    pace: str
    process: BatchFunction | None = None
    path: str | None = None  # Parquet target of a query without a batch function


@dataclass
class Started:
    queries: dict[str, StreamingQuery] = field(default_factory=dict)
    failures: dict[str, Exception] = field(default_factory=dict)


def market_jobs(store: MarketStore, sources: dict[str, DataFrame], first_batch: int = 0) -> list[Job]:
    """The three pipelines over raw topic streams, keyed by topic name.

    `first_batch` is kept with the checkpoints: it changes only when they are thrown away.
    """
    return [
        Job(
            "candles",
            counted(pipelines.classified_candles(sources[schemas.CANDLE_TOPIC]), "candle_rows"),
            CANDLE_PACE,
            pipelines.candle_batch(store, first_batch=first_batch),
        ),
        Job(
            "news",
            counted(pipelines.classified_news(sources[schemas.NEWS_TOPIC]), "news_rows"),
            NEWS_PACE,
            pipelines.news_batch(store, first_batch=first_batch),
        ),
        Job(
            "observations",
            counted(pipelines.classified_observations(sources[schemas.OBSERVATION_TOPIC]), "observation_rows"),
            ECONOMIC_PACE,
            pipelines.observation_batch(store, first_batch=first_batch),
        ),
    ]


def start(job: Job, checkpoints: str, drain: bool = False) -> StreamingQuery:
    """Start one query with its own checkpoint. `drain` processes what is there and stops."""
    writer: DataStreamWriter = (
        job.rows.writeStream.queryName(job.name)
        .option("checkpointLocation", f"{checkpoints}/{job.name}")
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=job.pace)
    if job.process is not None:
        return writer.foreachBatch(job.process).start()
    return writer.format("parquet").option("path", job.path).start()


def start_all(spark: SparkSession, jobs: list[Job], checkpoints: str, drain: bool = False) -> Started:
    """Start every query; one that cannot start does not keep the others from running."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    started = Started()
    for job in jobs:
        try:
            started.queries[job.name] = start(job, checkpoints, drain)
        except Exception as error:  # noqa: BLE001 - recorded, and the other queries still start
            log.exception("query %s did not start", job.name)
            started.failures[job.name] = error
    return started


def run(spark: SparkSession, jobs: list[Job], checkpoints: str) -> None:
    """Start the queries and wait until one of them ends; its error, if any, is raised."""
    started = start_all(spark, jobs, checkpoints)
    if not started.queries:
        raise RuntimeError("no query could be started")
    spark.streams.awaitAnyTermination()


def drain(spark: SparkSession, jobs: list[Job], checkpoints: str) -> Started:
    """Process everything available now in every query, and return when all are done."""
    started = start_all(spark, jobs, checkpoints, drain=True)
    for query in started.queries.values():
        query.awaitTermination()
    return started


def late_rows(query: StreamingQuery) -> int:
    """Rows the query's stateful operators dropped as too late, over its recent progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def batch_counts(query: StreamingQuery, name: str) -> list[dict]:
    """The row counts observed in each recent batch."""
    return [p["observedMetrics"][name] for p in query.recentProgress if name in p.get("observedMetrics", {})]
