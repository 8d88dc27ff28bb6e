"""Stock summaries, series, pages, history and search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.measures import direction, risk_tier, with_measures
from tapewright.functions.numbers import is_finite, or_zero
from tapewright.functions.text import contains_text, is_blank
from tapewright.functions.times import day_literal, hours_before, in_span, like, moment
from tapewright.operators.latest import latest_by_unique
from tapewright.operators.points import join_points, metric_point, resample, resample_measures
from tapewright.operators.ranking import page_of, top
from tapewright.operators.series import page_of_series

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def summarise(candles: DataFrame, as_of: datetime | str) -> DataFrame:
    """One summary row per symbol from its newest candle. (symbol, ts) must be unique.

    The newest candle is found first, so the measures are computed once per symbol.
    """
    newest = latest_by_unique(
        candles.select("symbol", "ts", "open", "high", "low", "close", "volume"), ["symbol"], "ts"
    )
    return summary_rows(with_measures(newest, as_of))


def summary_rows(measured: DataFrame, *keep: str) -> DataFrame:
    """Measured candles in the layout of the summary table."""
    c = F.col
    return measured.select(
        "symbol",
        c("ts").alias("last_timestamp"),
        c("close").alias("current_price"),
        c("volume").cast("bigint").alias("latest_volume"),
        or_zero(c("volatility")).alias("latest_volatility"),
        or_zero(c("risk_score")).alias("latest_risk_score"),
        c("trend").alias("latest_trend"),
        "calculation_date",
        or_zero(c("price_change")).alias("price_change_today"),
        or_zero(c("price_change_percent")).alias("price_change_percent_today"),
        *keep,
    )


def is_valid(summaries_price: str = "current_price") -> Column:
    """A named symbol whose price is unknown or not negative. NaN is not accepted."""
    price = F.col(summaries_price)
    return ~is_blank(F.col("symbol")) & (price.isNull() | ((price >= 0) & ~F.isnan(price)))


def is_active(summaries: DataFrame, as_of: datetime | str) -> Column:
    """Seen within the 24 hours before as_of, or never timed."""
    seen = F.col("last_timestamp")
    return seen.isNull() | (seen > like(hours_before(as_of, 24), summaries, "last_timestamp"))


def as_response(summaries: DataFrame, *keep: str) -> DataFrame:
    """The summary as queries return it; figures the table does not hold stay null."""
    c, nothing = F.col, F.lit(None).cast("double")
    time_type = summaries.schema["last_timestamp"].dataType
    return summaries.select(
        "symbol",
        or_zero(c("current_price")).alias("current_price"),
        c("latest_volume").alias("volume"),
        c("latest_volatility").alias("volatility"),
        c("price_change_today").alias("price_change"),
        c("price_change_percent_today").alias("price_change_percent"),
        nothing.alias("volume_average"),
        c("latest_risk_score").alias("risk_score"),
        c("latest_trend").alias("trend"),
        nothing.alias("support"),
        nothing.alias("resistance"),
        F.coalesce(c("last_timestamp"), F.lit("1970-01-01 00:00:00").cast(time_type)).alias("ts"),
        *keep,
    )


def latest_stock(summaries: DataFrame, symbol: str) -> DataFrame:
    return as_response(summaries.where(F.col("symbol") == symbol.upper()))


def stock_page(summaries: DataFrame, page: int = 0, size: int = 50) -> DataFrame:
    """One page of valid summaries by symbol, with the page envelope on every row."""
    rows = page_of(summaries.where(is_valid()), ["symbol"], page, size)
    envelope = ("page", "size", "total_elements", "total_pages", "has_next", "has_previous")
    return as_response(rows, *envelope)


def _in_range(points: DataFrame, symbol: str, as_of: datetime | str, hours: float) -> DataFrame:
    """Start inclusive, stop exclusive; both bounds and the symbol reach the scan."""
    span = in_span(points, hours_before(as_of, hours), moment(as_of))
    return points.where((F.col("symbol") == symbol.upper()) & span)


def window_text(window: str) -> str:
    """'5m' to '5 minutes'."""
    number, unit = window[:-1], window[-1:]
    if not number.isdigit() or int(number) == 0 or unit not in _UNITS:
        raise ValueError(f"window must look like 5m or 1h, not {window!r}")
    return f"{number} {_UNITS[unit]}"


def stock_timeseries(
    prices: DataFrame,
    metrics: DataFrame,
    symbol: str,
    as_of: datetime | str,
    hours: float = 24,
    window: str | None = "5m",
) -> DataFrame:
    """Prices and measures of one symbol, merged by time and ordered by it.

    With a window both sides are resampled to it first; `window=None` returns the points as stored.
    """
    prices, metrics = (_in_range(side, symbol, as_of, hours) for side in (prices, metrics))
    if window is not None:
        prices, metrics = resample(prices, window_text(window)), resample_measures(metrics, window_text(window))
    return metric_point(join_points(prices, metrics)).orderBy("ts")


def top_performers(metrics: DataFrame, as_of: datetime | str, limit: int = 10, hours: float = 1) -> DataFrame:
    """Symbols by their last percent change in the hour before as_of; non-finite values are left out."""
    recent = metrics.where(in_span(metrics, hours_before(as_of, hours), moment(as_of)))
    last = recent.groupBy("symbol").agg(F.max_by("price_change_percent", "ts").alias("change_percent"))
    return top(last.where(is_finite(F.col("change_percent"))), [F.desc("change_percent"), F.asc("symbol")], limit)


_SORT_KEYS = {"symbol": None, "change": "price_change_percent_today", "volume": "latest_volume", "risk": "latest_risk_score"}


def search_stocks(
    summaries: DataFrame, term: str = "", sort_by: str = "symbol", descending: bool = False
) -> DataFrame:
    """Symbols containing the term, in the chosen order; a missing figure sorts as zero."""
    column = _SORT_KEYS[sort_by]
    key = F.col("symbol") if column is None else F.coalesce(F.col(column), F.lit(0))
    order = [key.desc() if descending else key.asc(), F.asc("symbol")]
    return summaries.where(contains_text(F.col("symbol"), term)).orderBy(*order)


def stock_history(
    measured: DataFrame,
    symbol: str,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    page: int = 0,
    size: int = 50,
) -> DataFrame:
    """One page of a symbol's measured candles, newest first; both bounds are inclusive."""
    rows = measured.where(F.col("symbol") == symbol.upper())
    partitioned = "day" in measured.columns
    if start is not None:
        rows = rows.where(F.col("ts") >= like(start, measured, "ts"))
        rows = rows.where(F.col("day") >= day_literal(moment(start))) if partitioned else rows
    if end is not None:
        rows = rows.where(F.col("ts") <= like(end, measured, "ts"))
        rows = rows.where(F.col("day") <= day_literal(moment(end))) if partitioned else rows
    points = rows.select(
        "symbol", "ts", F.col("close").alias("price"), "open", "high", "low", "volume", "volatility", "risk_score", "trend"
    )
    return page_of_series(points, "symbol", "ts", page, size).orderBy(F.desc("ts"))


def distinct_symbols(candles: DataFrame) -> DataFrame:
    return candles.select("symbol").distinct()


def risk_distribution(summaries: DataFrame) -> DataFrame:
    """How many symbols fall into each risk tier and direction of change."""
    return summaries.groupBy(
        risk_tier(F.col("latest_risk_score")).alias("tier"),
        direction(F.col("price_change_today")).alias("direction"),
    ).agg(F.count(F.lit(1)).alias("symbols"))
