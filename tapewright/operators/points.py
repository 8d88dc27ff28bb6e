"""Time-series points: long and wide form, joining, resampling, windowed means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRICE_FIELDS = ("open", "high", "low", "close", "volume")
METRIC_FIELDS = ("volatility", "risk_score", "price_change", "price_change_percent", "trend_numeric")


def to_long(points: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per (symbol, ts, field)."""
    return points.unpivot(["symbol", "ts"], [F.col(f).cast("double").alias(f) for f in fields], "field", "value")


def pivot_points(long_points: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per (symbol, ts) with a column per field.

    Conditional aggregates need one shuffle; pivot() would group by the field first and need two.
    """
    picks = [F.first(F.when(F.col("field") == f, F.col("value")), ignorenulls=True).alias(f) for f in fields]
    return long_points.groupBy("symbol", "ts").agg(*picks)


def join_points(prices: DataFrame, metrics: DataFrame) -> DataFrame:
    """Full outer join on (symbol, ts); a point may have prices, measures or both.

    Stored sides are grouped by (symbol, ts, day) to settle rewrites. Joining on the day as well,
    which follows from ts, lets the join reuse that partitioning.
    """
    keys = ["symbol", "ts"]
    if "day" in prices.columns and "day" in metrics.columns:
        keys.append("day")
    joined = prices.select(*keys, *PRICE_FIELDS).join(metrics.select(*keys, *METRIC_FIELDS), keys, "full")
    return joined.select("symbol", "ts", *PRICE_FIELDS, *METRIC_FIELDS).withColumn(
        "volume", F.col("volume").cast("bigint")
    )


def metric_point(joined: DataFrame) -> DataFrame:
    """The point as queries return it; the close is the price."""
    return joined.select(
        "symbol", "ts", F.col("close").alias("price"), "open", "high", "low", "volume", "volatility", "risk_score"
    )


def resample(candles: DataFrame, every: str) -> DataFrame:
    """First open, highest high, lowest low, last close, summed volume; labelled by window start.

    Pure aggregation, so a hot symbol is reduced in every task before the shuffle.
    """
    return (
        candles.groupBy("symbol", F.window("ts", every).alias("w"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def resample_measures(metrics: DataFrame, every: str) -> DataFrame:
    """The last measures of each window, labelled by window start."""
    picks = [F.max_by(f, "ts").alias(f) for f in METRIC_FIELDS]
    return (
        metrics.groupBy("symbol", F.window("ts", every).alias("w"))
        .agg(*picks)
        .select("symbol", F.col("w.start").alias("ts"), *METRIC_FIELDS)
    )


def windowed_mean(points: DataFrame, value: str, every: str = "15 minutes") -> DataFrame:
    """Mean per symbol and tumbling window; windows without points do not appear."""
    return (
        points.groupBy("symbol", F.window("ts", every).alias("w"))
        .agg(F.avg(value).alias(value))
        .select("symbol", F.col("w.end").alias("window_end"), value)
    )


def market_mean(window_means: DataFrame, value: str) -> DataFrame:
    """Unweighted mean over symbols, per window."""
    return window_means.groupBy("window_end").agg(F.avg(value).alias(value))


def collapsed_mean(window_means: DataFrame, value: str) -> DataFrame:
    """One mean over all windows and symbols, without a time."""
    return window_means.agg(F.avg(value).alias(value))


def price_domain(candles: DataFrame, padding: float = 0.05) -> DataFrame:
    """Lowest and highest close per symbol, and the chart bounds padded by a share of the span."""
    pad = (F.col("max_price") - F.col("min_price")) * padding
    return (
        candles.groupBy("symbol")
        .agg(F.min("close").alias("min_price"), F.max("close").alias("max_price"))
        .withColumns({"lower_bound": F.col("min_price") - pad, "upper_bound": F.col("max_price") + pad})
    )
