"""Risk and volatility reports."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.times import days_before, in_span, moment
from tapewright.operators.returns import (
    VOLATILITY_DAYS,
    daily_returns,
    lookback_days,
    period_days,
    risk_figures,
)

METHOD = "Historical Simulation"
_INSTRUMENT = ("name", "exchange", "currency", "sector", "industry", "description")


def _end(day: date | str | None, as_of: datetime | str) -> datetime:
    if day is None:
        return moment(as_of)
    return moment(date.fromisoformat(day) if isinstance(day, str) else day)


def with_instrument(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """Left lookup on the upper-cased symbol.

    The dimension grows with the number of instruments, so the join is left to Spark: broadcast
    below its size threshold, shuffled (with skew splitting) above.
    """
    meta = instruments.select(F.col("symbol").alias("__symbol"), *_INSTRUMENT)
    return rows.join(meta, F.upper(rows["symbol"]) == F.col("__symbol"), "left").drop("__symbol")


def stock_risk(
    candles: DataFrame,
    instruments: DataFrame,
    as_of: datetime | str,
    symbol: str | None = None,
    day: date | str | None = None,
    lookback: str = "252d",
    benchmark: str = "SPY",
) -> DataFrame:
    """Volatility, beta and tail risk at the end day, of one symbol or of all of them."""
    if not benchmark.strip():
        raise ValueError("benchmark must not be blank")
    end, days = _end(day, as_of), lookback_days(lookback)
    if symbol is not None:
        candles = candles.where(F.col("symbol").isin(symbol.upper(), benchmark))
    figures = risk_figures(candles, benchmark, end, days)
    if symbol is not None:
        figures = figures.where(F.col("symbol") == symbol.upper())
    report = figures.withColumns(
        {
            "date": F.lit(end.date().isoformat()),
            "benchmark": F.lit(benchmark),
            "lookback_period": F.lit(lookback),
            "method": F.lit(METHOD),
        }
    )
    return with_instrument(report, instruments)


def stock_risk_from_summary(
    summaries: DataFrame,
    instruments: DataFrame,
    as_of: datetime | str,
    symbol: str | None = None,
    day: date | str | None = None,
    lookback: str = "252d",
    benchmark: str = "SPY",
) -> DataFrame:
    """The report without a history: the latest candle's volatility for every period, the rest null."""
    lookback_days(lookback)
    if symbol is not None:
        summaries = summaries.where(F.col("symbol") == symbol.upper())
    latest, nothing = F.col("latest_volatility"), F.lit(None).cast("double")
    report = summaries.select(
        "symbol",
        *(latest.alias(f"vol_{n}d") for n in VOLATILITY_DAYS),
        *(nothing.alias(name) for name in ("beta", "var_95", "var_99", "cvar_95", "cvar_99")),
        F.lit(_end(day, as_of).date().isoformat()).alias("date"),
        F.lit(benchmark).alias("benchmark"),
        F.lit(lookback).alias("lookback_period"),
        F.lit(f"{METHOD} (Placeholder)").alias("method"),
    )
    return with_instrument(report, instruments)


def period_names(periods: str) -> list[str]:
    return list(dict.fromkeys(p.strip().lower() for p in periods.split(",")))


def _last_volatility(
    metrics: DataFrame, as_of: datetime | str, symbol: str | None, periods: str, end_date: date | str | None
) -> DataFrame:
    stop = moment(as_of)
    rows = metrics.where(in_span(metrics, days_before(stop, period_days(periods)), stop))
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol.upper())
    last = rows.groupBy("symbol").agg(F.max_by("volatility", "ts").alias("last_volatility"))
    entries = [c for name in period_names(periods) for c in (F.lit(name), F.col("last_volatility"))]
    return last.select(
        "symbol",
        F.create_map(*entries).alias("periods"),
        F.lit(_end(end_date, as_of).date().isoformat()).alias("end_date"),
    )


def stock_volatility(
    metrics: DataFrame,
    instruments: DataFrame,
    as_of: datetime | str,
    symbol: str | None = None,
    periods: str = "30d,60d,90d",
    end_date: date | str | None = None,
) -> DataFrame:
    """The last stored volatility in the longest period, under every requested period's name."""
    return with_instrument(_last_volatility(metrics, as_of, symbol, periods, end_date), instruments)


def period_volatility(
    candles: DataFrame, as_of: datetime | str, periods: str = "30d,60d,90d", end_date: date | str | None = None
) -> DataFrame:
    """Deviation of the daily returns in each requested period, one column per period."""
    end = _end(end_date, as_of).date()
    names = period_names(periods)
    firsts = {name: end - timedelta(days=period_days(name) - 1) for name in names}
    added = []
    for name, first in firsts.items():
        ret = F.when(F.col("day") >= F.lit(first.isoformat()).cast("date"), F.col("ret"))
        added.append(F.when(F.count(ret) >= 2, F.stddev_samp(ret)).alias(f"vol_{name}"))
    return daily_returns(candles, min(firsts.values()), end).groupBy("symbol").agg(*added)


def market_index(
    candles: DataFrame,
    metrics: DataFrame,
    instruments: DataFrame,
    as_of: datetime | str,
    symbol: str | None = None,
    lookback: str = "252d",
    benchmark: str = "SPY",
    periods: str = "30d,60d,90d",
) -> DataFrame:
    """Risk and volatility blocks of the same index symbol; both must be there."""
    risk = stock_risk(candles, instruments, as_of, symbol, lookback=lookback, benchmark=benchmark)
    return risk.join(_last_volatility(metrics, as_of, symbol, periods, None), "symbol")
