"""Per-candle risk measures and labels."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.numbers import above, at_least, or_zero
from tapewright.functions.times import moment


def range_volatility(high: Column, low: Column, close: Column) -> Column:
    return F.when(above(high, low) & above(close, 0), (high - low) / close).otherwise(0.0)


def percent_change(change: Column, open_: Column) -> Column:
    return F.when(above(open_, 0), change / open_ * 100.0).otherwise(0.0)


def trend(percent: Column) -> Column:
    return F.when(above(percent, 1.0), "BULLISH").when(percent < -1.0, "BEARISH").otherwise("NEUTRAL")


def trend_number(label: Column) -> Column:
    name = F.upper(label)
    return F.when(name == "BULLISH", 1.0).when(name == "BEARISH", -1.0).otherwise(0.0)


def risk_tier(score: Column) -> Column:
    return F.when(at_least(score, 70), "high").when(at_least(score, 40), "medium").otherwise("low")


def direction(change: Column) -> Column:
    return F.when(above(change, 0), "up").when(change < 0, "down").otherwise("flat")


def with_measures(candles: DataFrame, as_of: datetime | str) -> DataFrame:
    """Valid candles plus the derived measures; one projection, no shuffle."""
    c = F.col
    return (
        candles.withColumns(
            {
                "volatility": range_volatility(c("high"), c("low"), c("close")),
                "price_change": c("close") - c("open"),
            }
        )
        .withColumns(
            {
                "price_change_percent": percent_change(c("price_change"), c("open")),
                "risk_score": c("volatility") * 100.0,
                "volume_average": c("volume").cast("double"),
                "calculation_date": F.lit(moment(as_of).date().isoformat()),
            }
        )
        .withColumn("trend", trend(c("price_change_percent")))
    )


def stored_metrics(measured: DataFrame, *keep: str) -> DataFrame:
    """The metric point as written: missing measures become 0.0, the trend becomes a number."""
    fields = ("volatility", "risk_score", "price_change", "price_change_percent")
    return measured.select(
        "symbol",
        "ts",
        *(or_zero(F.col(f)).alias(f) for f in fields),
        trend_number(F.col("trend")).alias("trend_numeric"),
        *keep,
    )
