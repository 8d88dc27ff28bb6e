"""Economic observations, indicator summaries and their metadata."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright import schemas
from tapewright.functions.checks import observation_reason
from tapewright.functions.text import is_blank
from tapewright.functions.times import days_before, in_span, like, moment, observation_date, observation_midnight
from tapewright.operators.latest import insert_if_absent, latest_per_key
from tapewright.operators.ranking import page_of, top, top_per_key

_METADATA = ("title", "frequency", "units", "notes", "source")


def parse_observations(records: DataFrame) -> DataFrame:
    """Text observations to typed ones, classified. `records` has series_id, observation_date, value.

    An unreadable date is a reject: neither the point nor the summary is written.
    """
    return (
        records.withColumnRenamed("value", "raw_value")
        .withColumn("value", F.when(F.col("raw_value") != ".", F.col("raw_value").try_cast("double")))
        .withColumn("ts", observation_midnight(F.col("observation_date")))
        .withColumn("reason", observation_reason())
    )


def latest_indicators(observations: DataFrame) -> DataFrame:
    """Newest observation per series: by observation date, then by arrival.

    `observations` has series_id, ts, observation_date, value, arrival and processed_at.
    """
    rows = observations.select("series_id", "ts", "arrival", "observation_date", "value", "processed_at")
    return latest_per_key(rows, ["series_id"], ["ts", "arrival"]).select(
        F.col("series_id").alias("indicator"),
        F.col("processed_at").alias("last_timestamp"),
        F.col("value").alias("latest_value"),
        "observation_date",
        "arrival",
    )


def known_metadata(spark: SparkSession, last_updated: datetime | str) -> DataFrame:
    """The fixed metadata rows, six of them."""
    rows = [(s, t, f, u, None, src) for s, t, f, u, src in schemas.KNOWN_SERIES]
    fields = [f for f in schemas.INDICATOR_METADATA.fieldNames() if f != "last_updated"]
    known = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))
    return known.withColumn("last_updated", F.lit(str(last_updated)).cast("timestamp"))


def missing_metadata(series: DataFrame, known: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to insert: series seen in the data, described in the known map, not yet in the table.

    `known` is a fixed map of a few rows and is the broadcast side; unknown series drop out here.
    """
    seen = series.select(F.upper("series_id").alias("series_id")).distinct()
    return insert_if_absent(existing, seen.join(known, "series_id"), "series_id")


def _with_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left lookup on the upper-cased id. The join side is chosen by size, not hinted."""
    meta = metadata.select(F.col("series_id").alias("__series"), *_METADATA)
    return rows.join(meta, F.upper("indicator") == F.col("__series"), "left").drop("__series")


def _response(summaries: DataFrame, metadata: DataFrame, as_of: datetime | str, *keep: str) -> DataFrame:
    day = observation_date(F.col("observation_date"), F.col("last_timestamp"), as_of).cast("string")
    joined = _with_metadata(summaries, metadata)
    return joined.select(
        F.col("indicator").alias("series_id"),
        day.alias("observation_date"),
        F.col("latest_value").alias("value"),
        day.alias("real_time_start"),
        day.alias("real_time_end"),
        *_METADATA,
        *keep,
    )


def indicator(summaries: DataFrame, metadata: DataFrame, indicator_id: str, as_of: datetime | str) -> DataFrame:
    return _response(summaries.where(F.col("indicator") == indicator_id.upper()), metadata, as_of)


def indicator_summaries(summaries: DataFrame, metadata: DataFrame, as_of: datetime | str) -> DataFrame:
    """All named indicators with their metadata."""
    return _response(summaries.where(~is_blank(F.col("indicator"))), metadata, as_of)


def indicator_page(
    summaries: DataFrame, metadata: DataFrame, as_of: datetime | str, page: int = 0, size: int = 20
) -> DataFrame:
    """One page by indicator id; metadata is looked up for the page's rows only."""
    rows = page_of(summaries.where(~is_blank(F.col("indicator"))), ["indicator"], page, size)
    envelope = ("page", "size", "total_elements", "total_pages", "has_next", "has_previous")
    return _response(rows, metadata, as_of, *envelope)


def indicator_timeseries(observations: DataFrame, series_id: str, as_of: datetime | str, days: float = 30) -> DataFrame:
    """Points of one series in [as_of - days, as_of), ordered by time."""
    span = in_span(observations, days_before(as_of, days), moment(as_of))
    rows = observations.where((F.col("series_id") == series_id.upper()) & span)
    return rows.where(F.col("value").isNotNull()).select("series_id", "value", "ts").orderBy("ts")


def indicator_observations(
    observations: DataFrame,
    metadata: DataFrame,
    series_id: str,
    start: date | str | None = None,
    end: date | str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Newest observations of one series between optional inclusive dates, with its metadata."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    rows = observations.where(F.col("series_id") == series_id.upper())
    if start is not None:
        rows = rows.where(F.col("ts") >= like(_day(start), observations, "ts"))
    if end is not None:
        rows = rows.where(F.col("ts") <= like(_day(end), observations, "ts"))
    newest = top(rows.select(F.col("series_id").alias("indicator"), "ts", "value"), [F.desc("ts")], limit)
    return _with_metadata(newest, metadata).withColumnRenamed("indicator", "series_id")


def _day(value: date | str) -> datetime:
    day = date.fromisoformat(value) if isinstance(value, str) else value
    return datetime(day.year, day.month, day.day)


def newest_observations(observations: DataFrame, n: int) -> DataFrame:
    """The newest n points of every series."""
    return top_per_key(observations, ["series_id"], [F.desc("ts")], n)
