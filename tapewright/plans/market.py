"""Market overview, movers and market volatility."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.numbers import above, is_finite, or_zero
from tapewright.functions.times import hours_before, in_span, like, moment
from tapewright.operators.points import collapsed_mean, market_mean, windowed_mean
from tapewright.operators.ranking import top, top_per_key
from tapewright.plans.stocks import is_active, is_valid

HIGH_RISK = 70.0
MAJORITY = 0.6
MOVERS = 5


def _sentiment(bullish: Column, bearish: Column, total: Column) -> Column:
    """BULLISH or BEARISH when more than 60 % of the symbols share the trend; NEUTRAL for none."""
    return (
        F.when(F.try_divide(bullish, total) > MAJORITY, "BULLISH")
        .when(F.try_divide(bearish, total) > MAJORITY, "BEARISH")
        .otherwise("NEUTRAL")
    )


def sentiment_by(rows: DataFrame, key: str, trend: str) -> DataFrame:
    """The market sentiment of each group of rows, such as all candles of a day."""
    label = F.col(trend)
    counts = rows.groupBy(key).agg(
        F.count_if(label == "BULLISH").alias("bullish"),
        F.count_if(label == "BEARISH").alias("bearish"),
        F.count(F.lit(1)).alias("total"),
    )
    mood = _sentiment(F.col("bullish"), F.col("bearish"), F.col("total"))
    return counts.select(key, mood.alias("sentiment"))


def market_overview(summaries: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row: totals, mean risk of active symbols, market sentiment.

    The symbols above the risk limit are counted here and listed by `high_risk_symbols`, as rows: a
    list in this row would gather them all in one task.
    """
    valid = is_valid()
    active = valid & is_active(summaries, as_of)
    risk, trend = F.col("latest_risk_score"), F.col("latest_trend")
    totals = summaries.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(valid).alias("total_stocks"),
        F.count_if(active).alias("active_stocks"),
        F.coalesce(F.avg(F.when(active & is_finite(risk), risk)), F.lit(0.0)).alias("average_risk_score"),
        F.count_if(active & above(or_zero(risk), HIGH_RISK)).alias("high_risk_stocks"),
        F.count_if(active & (trend == "BULLISH")).alias("bullish"),
        F.count_if(active & (trend == "BEARISH")).alias("bearish"),
    )
    mood = _sentiment(F.col("bullish"), F.col("bearish"), F.col("active_stocks"))
    sentiment = F.when(F.col("rows") == 0, "UNKNOWN").otherwise(mood)
    return totals.select(
        "total_stocks",
        "active_stocks",
        "average_risk_score",
        "high_risk_stocks",
        sentiment.alias("market_sentiment"),
        like(as_of, summaries, "last_timestamp").alias("last_updated"),
    )


def active_summaries(summaries: DataFrame, as_of: datetime | str) -> DataFrame:
    return summaries.where(is_valid() & is_active(summaries, as_of))


def high_risk_symbols(summaries: DataFrame, as_of: datetime | str) -> DataFrame:
    """Active symbols with a score above 70, one row each, ordered by symbol."""
    risky = above(or_zero(F.col("latest_risk_score")), HIGH_RISK)
    return active_summaries(summaries, as_of).where(risky).select("symbol", "latest_risk_score").orderBy("symbol")


# name -> (which active symbols are in the list, what puts them first when small)
_LISTS = {
    "gainers": (
        lambda: above(or_zero(F.col("price_change_percent_today")), 0),
        lambda: -F.col("price_change_percent_today"),
    ),
    "losers": (
        lambda: or_zero(F.col("price_change_percent_today")) < 0,
        lambda: F.col("price_change_percent_today"),
    ),
    "most_volatile": (lambda: is_finite(F.col("latest_volatility")), lambda: -F.col("latest_volatility")),
}


def _mover(summaries: DataFrame, *keep: str) -> DataFrame:
    c = F.col
    return summaries.select(
        "symbol",
        "current_price",
        c("price_change_today").alias("change"),
        c("price_change_percent_today").alias("change_percent"),
        c("latest_volume").alias("volume"),
        *keep,
    )


def _movers(active: DataFrame, name: str, n: int) -> DataFrame:
    member, rank = _LISTS[name]
    return _mover(top(active.where(member()), [rank().asc(), F.asc("symbol")], n))


def top_gainers(active: DataFrame, n: int = MOVERS) -> DataFrame:
    return _movers(active, "gainers", n)


def top_losers(active: DataFrame, n: int = MOVERS) -> DataFrame:
    return _movers(active, "losers", n)


def most_volatile(active: DataFrame, n: int = MOVERS) -> DataFrame:
    return _movers(active, "most_volatile", n)


def top_movers(active: DataFrame, n: int = MOVERS) -> DataFrame:
    """The three mover lists in one result and one pass; `list` names the list.

    A symbol is repeated for each list it belongs to, and every task keeps n rows per list.
    """
    entries = F.array(
        *(
            F.when(member(), F.struct(F.lit(name).alias("list"), rank().alias("rank")))
            for name, (member, rank) in _LISTS.items()
        )
    )
    listed = active.withColumn("__entry", F.explode(F.array_compact(entries)))
    ranked = listed.withColumns({"list": F.col("__entry.list"), "__key": F.col("__entry.rank")})
    return _mover(top_per_key(ranked, ["list"], [F.asc("__key"), F.asc("symbol")], n), "list")


def market_volatility(
    metrics: DataFrame, as_of: datetime | str, hours: float = 24, collapse: bool = False
) -> DataFrame:
    """Mean volatility over symbols per 15-minute window end, ordered by time.

    `collapse=True` gives one mean of all window means instead.
    """
    recent = metrics.where(in_span(metrics, hours_before(as_of, hours), moment(as_of)))
    means = windowed_mean(recent, "volatility")
    if collapse:
        return collapsed_mean(means, "volatility")
    return market_mean(means, "volatility").orderBy("window_end")
