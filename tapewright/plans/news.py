"""News queries over the bucketed news table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.text import same_text
from tapewright.functions.times import hours_before, like, moment
from tapewright.operators.ranking import top, top_per_key


def _newest_first() -> list[Column]:
    return [F.desc("ts"), F.asc("id")]


def bucket_page(news: DataFrame, date_bucket: str, n: int) -> DataFrame:
    """The newest n items of one day; only that day's files are read."""
    return top(news.where(F.col("date_bucket") == date_bucket), _newest_first(), n)


def bucket_top(news: DataFrame, n: int) -> DataFrame:
    """The newest n items of every day."""
    return top_per_key(news, ["date_bucket"], _newest_first(), n)


def _window(news: DataFrame, as_of: datetime | str, hours: float, depth: int | None) -> DataFrame:
    """Items after the cutoff, in the UTC days from the cutoff's to the as-of day; at most the last `depth` days if given."""
    last = moment(as_of).date()
    first = hours_before(as_of, hours).date()
    if depth is not None:
        first = max(first, last - timedelta(days=depth - 1))
    bucket = F.col("date_bucket")
    in_days = (bucket >= F.lit(first.isoformat())) & (bucket <= F.lit(last.isoformat()))
    return news.where(in_days & (F.col("ts") > like(hours_before(as_of, hours), news, "ts")))


def _item(news: DataFrame) -> DataFrame:
    return news.select("id", "headline", "summary", "sentiment", "ts", "source", "related_symbol")


def recent_news(
    news: DataFrame, as_of: datetime | str, hours: float = 24, limit: int = 50, depth: int | None = None
) -> DataFrame:
    """The newest items, newest first.

    Later days hold only later items, so one ordered cut over the days gives the same rows as
    walking them one by one until enough are found.
    """
    return _item(top(_window(news, as_of, hours, depth), _newest_first(), limit))


def news_by_sentiment(
    news: DataFrame, sentiment: str, as_of: datetime | str, hours: float = 24, limit: int = 20, depth: int | None = None
) -> DataFrame:
    """The newest items of a sentiment; items are picked before they are cut to the limit."""
    match = same_text(F.col("sentiment"), sentiment)
    return _item(top(_window(news, as_of, hours, depth).where(match), _newest_first(), limit))


def news_for_symbol(
    news: DataFrame, symbol: str, as_of: datetime | str, hours: float = 24, limit: int = 20, depth: int | None = None
) -> DataFrame:
    """The newest items related to a symbol; items are picked before they are cut to the limit."""
    match = same_text(F.col("related_symbol"), symbol)
    return _item(top(_window(news, as_of, hours, depth).where(match), _newest_first(), limit))
