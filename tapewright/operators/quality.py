"""Data-quality, request and quota statistics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.times import like

DEGRADED_BELOW = 95.0
DAILY_CALL_LIMIT = 25
ALERT_RATE = 0.1
ALERT_MINUTES = 5


def _percent(part: Column, whole: Column, when_empty: float) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(when_empty))


def valid_counts(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Valid and invalid rows per key."""
    good = F.col("reason").isNull()
    return classified.groupBy(*keys).agg(
        F.count_if(good).alias("valid_count"), F.count_if(~good).alias("invalid_count")
    )


def quality_rate(classified: DataFrame) -> DataFrame:
    """Share of valid rows in percent (100 when there are none) and whether it is too low."""
    valid, total = F.col("valid_count"), F.col("valid_count") + F.col("invalid_count")
    return (
        valid_counts(classified, [])
        .withColumn("quality_rate", _percent(valid, total, 100.0))
        .withColumn("degraded", F.col("quality_rate") < DEGRADED_BELOW)
    )


def request_stats(log: DataFrame, as_of: datetime | str) -> DataFrame:
    """Per service: successes, failures, success rate, seconds since the last success (-1: never)."""
    ok = F.col("ok") == 1
    now = like(as_of, log, "ts")
    seconds = lambda t: F.unix_seconds(t.cast("timestamp"))
    return (
        log.groupBy("service")
        .agg(
            F.count_if(ok).alias("successes"),
            F.count_if(~ok).alias("failures"),
            F.max(F.when(ok, F.col("ts"))).alias("last_success"),
            F.count(F.lit(1)).alias("calls"),
        )
        .select(
            "service",
            "successes",
            "failures",
            _percent(F.col("successes"), F.col("calls"), 0.0).alias("success_rate"),
            F.coalesce(seconds(now) - seconds(F.col("last_success")), F.lit(-1).cast("bigint")).alias("seconds_since_success"),
            "calls",
        )
    )


def quota_usage(log: DataFrame, limit: int = DAILY_CALL_LIMIT) -> DataFrame:
    """Calls per service and UTC day against a daily limit."""
    return (
        log.groupBy("service", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(
            "service",
            "day",
            "calls",
            F.greatest(F.lit(limit) - F.col("calls"), F.lit(0)).cast("bigint").alias("remaining"),
            (F.col("calls") >= limit).alias("quota_reached"),
        )
    )


def hourly_usage(log: DataFrame) -> DataFrame:
    """Calls per service and hour."""
    return (
        log.groupBy("service", F.window("ts", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .select("service", F.col("w.start").alias("hour_start"), "calls")
    )


def rejection_windows(rejects: DataFrame) -> DataFrame:
    """Dead letters per source in five-minute windows ending at every minute, as a rate per second.

    Counting per minute first means a row is not multiplied by the five windows it falls into.
    """
    return windows_of_minutes(per_minute(rejects))


def windows_of_minutes(minutes: DataFrame) -> DataFrame:
    """The same from counts n per source and minute."""
    return (
        minutes.groupBy("source", F.window("minute", "5 minutes", "1 minute").alias("w"))
        .agg(F.sum("n").alias("rejects"))
        .select("source", F.col("w.end").alias("window_end"), "rejects", (F.col("rejects") / 300.0).alias("rate"))
    )


def per_minute(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("source", F.date_trunc("minute", "rejected_at").alias("minute")).agg(
        F.count(F.lit(1)).alias("n")
    )


def rejection_alerts(windows: DataFrame, threshold: float = ALERT_RATE, minutes: int = ALERT_MINUTES) -> DataFrame:
    """Window ends at which the rate has been above the threshold for five minutes running.

    The input has one row per source and minute, so a source's series is bounded by the calendar.
    A minute without dead letters has no row and so breaks the run.
    """
    high = windows.where(F.col("rate") > threshold)
    second = F.unix_seconds(F.col("window_end").cast("timestamp"))
    run = Window.partitionBy("source").orderBy("__second").rangeBetween(-(minutes - 1) * 60, 0)
    return (
        high.withColumn("__second", second)
        .withColumn("held", F.count(F.lit(1)).over(run))
        .where(F.col("held") >= minutes)
        .select("source", "window_end", "rejects", "rate")
    )
