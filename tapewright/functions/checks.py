"""Validity rules. Each returns the reason a row is refused, or null for a good row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.numbers import above
from tapewright.functions.text import is_blank
from tapewright.schemas import CORRUPT

PRICES = ("open", "high", "low", "close")
# Epoch values from here on are milliseconds where seconds are due.
SECONDS_LIMIT = 100_000_000_000


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds. A rule that evaluates to null does not hold."""
    condition, name = rules[0]
    return reduce(lambda acc, rule: acc.when(*rule), rules[1:], F.when(condition, name))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def candle_reason() -> Column:
    """Stored candles: symbol, complete positive prices, volume, time, high not below low."""
    prices = [F.col(p) for p in PRICES]
    return first_reason(
        (is_blank(F.col("symbol")), "blank_symbol"),
        (F.col("ts").isNull(), "missing_time"),
        (any_of([p.isNull() | F.isnan(p) for p in prices]), "missing_price"),
        (F.col("volume").isNull(), "missing_volume"),
        (any_of([p <= 0 for p in prices]), "price_not_positive"),
        (F.col("high") < F.col("low"), "high_below_low"),
    )


def vendor_candle_reason() -> Column:
    """Vendor bars: as stored candles, and the range must enclose open and close."""
    prices = [F.col(p) for p in PRICES]
    high, low = F.col("high"), F.col("low")
    return first_reason(
        (is_blank(F.col("symbol")), "blank_symbol"),
        (F.col("ts").isNull(), "bad_time"),
        (any_of([~above(p, 0) for p in prices]), "price_not_positive"),
        (high < low, "high_below_low"),
        ((high < F.col("open")) | (high < F.col("close")), "high_below_price"),
        ((low > F.col("open")) | (low > F.col("close")), "low_above_price"),
    )


def quote_reason() -> Column:
    """Normalised quotes: a price, and a range that encloses the close."""
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    return first_reason(
        (is_blank(F.col("symbol")), "blank_symbol"),
        (F.col(CORRUPT).isNotNull(), "unreadable"),
        (close.isNull(), "no_price"),
        (F.col("t") >= SECONDS_LIMIT, "time_not_in_seconds"),
        (high < low, "high_below_low"),
        (high < close, "high_below_close"),
        (low > close, "low_above_close"),
    )


def vendor_news_reason(headline_limit: int | None = None, summary_limit: int | None = None) -> Column:
    """Vendor news items; texts of any length pass unless a limit is given."""
    c = F.col
    limits = (("headline", headline_limit), ("summary", summary_limit))
    return first_reason(
        (is_blank(c("headline")), "blank_headline"),
        (is_blank(c("summary")), "blank_summary"),
        (is_blank(c("url")), "blank_url"),
        *((F.length(c(name)) > limit, f"{name}_too_long") for name, limit in limits if limit is not None),
        (~c("url").startswith("http"), "url_not_http"),
        (c("datetime") >= SECONDS_LIMIT, "time_not_in_seconds"),
    )


def news_reason() -> Column:
    """Decoded news records: required fields present, headline and summary not blank."""
    c = F.col
    return first_reason(
        (c("datetime").isNull(), "missing_time"),
        (c("id").isNull(), "missing_id"),
        (c("url").isNull(), "missing_url"),
        (is_blank(c("headline")), "blank_headline"),
        (is_blank(c("summary")), "blank_summary"),
    )


def observation_reason() -> Column:
    """Economic records: '.' stands for a missing value; dates must be real."""
    c = F.col
    return first_reason(
        (is_blank(c("series_id")), "blank_series"),
        (c("observation_date").isNull(), "missing_date"),
        (c("raw_value").isNull(), "missing_value"),
        (c("raw_value") == ".", "no_observation"),
        (c("value").isNull(), "value_not_a_number"),
        (c("ts").isNull(), "bad_date"),
    )
