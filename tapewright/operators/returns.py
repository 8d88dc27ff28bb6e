"""Daily returns and the risk figures built on them.

Everything starts from daily closes: one aggregation takes any candle grain to at most one row per
symbol and day, combined in every task before the shuffle. From there on a symbol's series is
bounded by the calendar (about 365 rows a year), so windows and arrays per symbol stay small even
when one symbol holds a third of all candles.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.times import literal, moment
from tapewright.operators.series import trailing_rows

TRAILING = 20
VOLATILITY_DAYS = (30, 60, 90)
UNIT_DAYS = {"d": 1, "m": 30, "y": 365}


def lookback_days(text: str) -> int:
    """'252d', '6m', '1y' to days; hours are refused, since returns are daily."""
    match = re.fullmatch(r"(\d+)([dmyh])", text)
    if not match:
        raise ValueError(f"lookback must look like 252d or 1y, not {text!r}")
    if match[2] == "h":
        raise ValueError("a lookback in hours has no daily returns")
    return int(match[1]) * UNIT_DAYS[match[2]]


def period_days(periods: str) -> int:
    """The longest of 'Nd,Nm,Ny' in days; what does not parse is left out (30 if nothing is left)."""
    days = []
    for period in (p.strip().lower() for p in periods.split(",")):
        number, unit = period[:-1], period[-1:]
        whole = int(number) if re.fullmatch(r"[+-]?\d+", number) else None
        if unit == "d" and whole is not None:
            days.append(whole)
        elif unit in ("m", "y"):
            days.append((1 if whole is None else whole) * UNIT_DAYS[unit])
    return max(days, default=30)


def daily_closes(candles: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """The last close of every symbol and day.

    With a first day, everything older collapses into one row per symbol, stamped the day before:
    the previous close of the first return, however far back it lies.
    """
    day = F.to_date("ts")
    if last is not None:
        stop = moment(last) + timedelta(days=1)
        candles = candles.where(F.col("ts") < literal(stop, candles.schema["ts"].dataType))
        if "day" in candles.columns:
            candles = candles.where(F.col("day") <= _date(last))
    if first is not None:
        day = F.greatest(day, _date(first - timedelta(days=1)))
    return candles.select("symbol", "ts", "close", day.alias("day")).groupBy("symbol", "day").agg(
        F.max_by("close", "ts").alias("close")
    )


def _date(value: date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def daily_returns(candles: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """close / previous close - 1 between a symbol's consecutive days with data; first day null."""
    previous = F.lag("close").over(Window.partitionBy("symbol").orderBy(F.unix_date("day")))
    returns = daily_closes(candles, first, last).withColumn("ret", F.try_divide(F.col("close"), previous) - 1)
    return returns if first is None else returns.where(F.col("day") >= _date(first))


def recent_returns(candles: DataFrame, end: datetime | str, lookback: int) -> DataFrame:
    """Returns of the last `lookback` calendar days up to and including the end day."""
    last = moment(end).date()
    returns = daily_returns(candles, last - timedelta(days=lookback - 1), last)
    return returns.where(F.col("ret").isNotNull())


def historical_volatility(returns: DataFrame, windows: tuple[int, ...] = VOLATILITY_DAYS) -> DataFrame:
    """Sample deviation of the returns in the trailing N calendar days, for each N; null below two."""

    def over(n: int):
        return Window.partitionBy("symbol").orderBy(F.unix_date("day")).rangeBetween(-(n - 1), 0)

    added = {
        f"vol_{n}d": F.when(F.count("ret").over(over(n)) >= 2, F.stddev_samp("ret").over(over(n))) for n in windows
    }
    return returns.withColumns(added)


def benchmark_returns(candles: DataFrame, benchmark: str, end: datetime | str, lookback: int) -> DataFrame:
    """(day, bench_ret) of one symbol: at most one row per calendar day of the lookback; how it is joined is left to Spark."""
    return recent_returns(candles.where(F.col("symbol") == benchmark), end, lookback).select(
        "day", F.col("ret").alias("bench_ret")
    )


def _beta() -> Column:
    """Over rows that have both returns; rows without a benchmark return do not count."""
    variance = F.var_samp(F.when(F.col("ret").isNotNull(), F.col("bench_ret")))
    return F.when(variance > 0, F.covar_samp("ret", "bench_ret") / F.when(variance > 0, variance))


def beta(candles: DataFrame, benchmark: str, end: datetime | str, lookback: int) -> DataFrame:
    """Covariance with the benchmark over its variance, on common days; null for a flat benchmark."""
    bench = benchmark_returns(candles, benchmark, end, lookback)
    return (
        recent_returns(candles, end, lookback)
        .join(bench, "day")
        .groupBy("symbol")
        .agg(_beta().alias("beta"), F.count(F.lit(1)).alias("common_days"))
    )


def _cuts() -> Column:
    """The 5 % and 1 % points of the returns, interpolated."""
    return F.percentile("ret", F.array(F.lit(0.05), F.lit(0.01)))


def _shortfall(rets: Column, cut: Column) -> Column:
    """Minus the mean of the returns at or below the cut."""
    tail = F.filter(rets, lambda r: r <= cut)
    return -F.try_divide(F.aggregate(tail, F.lit(0.0), lambda a, r: a + r), F.size(tail))


def tail_risk(candles: DataFrame, end: datetime | str, lookback: int) -> DataFrame:
    """Value at risk and its conditional form at 95 and 99 %, by historical simulation.

    One aggregation; the array it fills holds a symbol's returns in the lookback, one per day.
    """
    grouped = (
        recent_returns(candles, end, lookback)
        .groupBy("symbol")
        .agg(_cuts().alias("cuts"), F.collect_list("ret").alias("rets"), F.count(F.lit(1)).alias("observations"))
    )
    cuts, rets = F.col("cuts"), F.col("rets")
    return grouped.select(
        "symbol",
        "observations",
        (-cuts[0]).alias("var_95"),
        (-cuts[1]).alias("var_99"),
        _shortfall(rets, cuts[0]).alias("cvar_95"),
        _shortfall(rets, cuts[1]).alias("cvar_99"),
    )


def risk_figures(candles: DataFrame, benchmark: str, end: datetime | str, lookback: int) -> DataFrame:
    """All risk figures per symbol at the end day, in one aggregation over the returns.

    Volatilities use their own 30, 60 and 90 days, whatever the lookback of the other figures.
    """
    span = max(lookback, *VOLATILITY_DAYS)
    day, last = F.col("day"), _date(moment(end).date())
    bench = benchmark_returns(candles, benchmark, end, lookback)
    inside = day > F.date_sub(last, lookback)
    rows = recent_returns(candles, end, span).join(bench, "day", "left").withColumn("all_ret", F.col("ret"))
    # Rows outside the lookback serve the volatilities only.
    rows = rows.withColumn("ret", F.when(inside, F.col("ret")))
    vols = {n: F.when(day > F.date_sub(last, n), F.col("all_ret")) for n in VOLATILITY_DAYS}
    grouped = rows.groupBy("symbol").agg(
        *(F.when(F.count(r) >= 2, F.stddev_samp(r)).alias(f"vol_{n}d") for n, r in vols.items()),
        _beta().alias("beta"),
        _cuts().alias("cuts"),
        F.collect_list("ret").alias("rets"),
    )
    cuts, rets = F.col("cuts"), F.col("rets")
    return grouped.select(
        "symbol",
        *(f"vol_{n}d" for n in VOLATILITY_DAYS),
        "beta",
        (-cuts[0]).alias("var_95"),
        (-cuts[1]).alias("var_99"),
        _shortfall(rets, cuts[0]).alias("cvar_95"),
        _shortfall(rets, cuts[1]).alias("cvar_99"),
    )


def volume_average(candles: DataFrame, rows: int = TRAILING, grain: str = "day") -> DataFrame:
    """Mean volume of the trailing rows of each symbol, the current one included."""
    return trailing_rows(candles, "symbol", "ts", rows, {"volume_average": F.avg("volume")}, grain)


def support_resistance(candles: DataFrame, rows: int = TRAILING, grain: str = "day") -> DataFrame:
    """Lowest low and highest high of the trailing rows."""
    levels = {"support": F.min("low"), "resistance": F.max("high")}
    return trailing_rows(candles, "symbol", "ts", rows, levels, grain)
