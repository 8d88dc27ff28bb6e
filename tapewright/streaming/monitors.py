"""Stateful streams: repeats removed within the watermark, windowed means, dead-letter rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.measures import range_volatility
from tapewright.operators.points import windowed_mean
from tapewright.operators.quality import per_minute

WATERMARK = "10 minutes"
CANDLE_FIELDS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def unique_candles(classified: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Accepted candles without exact repeats.

    All fields form the key: a correction of an earlier candle differs in some field and passes;
    which of the two counts is decided on read, by arrival.
    """
    good = classified.where(F.col("reason").isNull()).select(*CANDLE_FIELDS)
    return good.withWatermark("ts", delay).dropDuplicatesWithinWatermark(CANDLE_FIELDS)


def volatility_windows(classified: DataFrame, every: str = "15 minutes", delay: str = WATERMARK) -> DataFrame:
    """Mean volatility per symbol and tumbling window, final once the watermark has passed."""
    candles = unique_candles(classified, delay)
    points = candles.select(
        "symbol", "ts", range_volatility(F.col("high"), F.col("low"), F.col("close")).alias("volatility")
    )
    return windowed_mean(points, "volatility", every)


def complete_windows(closed: DataFrame, candles: DataFrame, every: str = "15 minutes") -> DataFrame:
    """The windows a stream has closed, and those it has not, rebuilt from the candles of the log.

    The watermark closes windows in the order of their ends, so what is missing ends after the last one closed; only
    that part of the log is read.
    """
    last = closed.agg(F.max("window_end")).first()[0]
    if last is not None:
        candles = candles.where(F.col("ts") >= F.lit(last))
    points = candles.select("symbol", "ts", range_volatility(F.col("high"), F.col("low"), F.col("close")).alias("volatility"))
    return closed.unionByName(windowed_mean(points, "volatility", every).select(closed.columns))


def rejection_counts(classified: DataFrame, source: str, delay: str = WATERMARK) -> DataFrame:
    """Dead letters per minute. Each row is counted once; quality.windows_of_minutes slides over the counts."""
    bad = classified.where(F.col("reason").isNotNull()).select(F.lit(source).alias("source"), F.col("ingest_time").alias("rejected_at"))
    return (
        bad.withWatermark("rejected_at", delay)
        .groupBy("source", F.window("rejected_at", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("source", F.col("w.start").alias("minute"), "n")
    )


def complete_counts(closed: DataFrame, rejects: DataFrame) -> DataFrame:
    """The minutes a stream has closed, and those it has not, counted from the dead letters."""
    last = closed.agg(F.max("minute")).first()[0]
    if last is not None:
        rejects = rejects.where(F.col("rejected_at") >= F.lit(last) + F.expr("INTERVAL 1 MINUTE"))
    return closed.unionByName(per_minute(rejects).select(closed.columns))
