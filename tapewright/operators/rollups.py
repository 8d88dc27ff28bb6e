"""Rollups of candles: partial aggregates per symbol at several widths, merged upward and corrected in place.

A state holds what merges: number, sums, extremes, and the first and last price with their times. A wider state is merged from narrower ones, so an
answer over a long span reads few rows. A corrected candle cannot be taken out of an extreme; the windows it lies in are
dirty, and only those are written again, the narrowest from the candles and the wider ones from the narrowest of the same days.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.measures import range_volatility
from tapewright.sources.store import MarketStore, arrival, utc_day

#: Log of each width, narrowest first.
LEVELS = (("rollup_1m", "1 minute"), ("rollup_15m", "15 minutes"), ("rollup_1d", "1 day"))


def _start(ts: str, every: str) -> Column:
    return F.window(ts, every)["start"]


def _singles(candles: DataFrame, *keep: str) -> DataFrame:
    """The state of every candle by itself."""
    volatility = range_volatility(F.col("high"), F.col("low"), F.col("close"))
    return candles.select(
        "symbol", "ts", F.lit(1).cast("bigint").alias("n"), volatility.alias("volatility_sum"), "open", F.col("ts").alias("open_ts"),
        "high", "low", "close", F.col("ts").alias("close_ts"), F.col("volume").cast("double").alias("volume"), *keep,
    )


def states(candles: DataFrame, every: str) -> DataFrame:
    """One state per symbol and window."""
    return merged(_singles(candles), every)


_STATE = ("n", "volatility_sum", "open", "open_ts", "high", "low", "close", "close_ts", "volume")


def _merges() -> list[Column]:
    """What makes one state of several; rows of nulls add nothing."""
    return [
        F.sum("n").alias("n"),
        F.sum("volatility_sum").alias("volatility_sum"),
        F.min_by("open", "open_ts").alias("open"),
        F.min("open_ts").alias("open_ts"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "close_ts").alias("close"),
        F.max("close_ts").alias("close_ts"),
        F.sum("volume").alias("volume"),
    ]


def merged(rows: DataFrame, every: str) -> DataFrame:
    """States over wider windows. A task adds up its own rows first, so a hot symbol moves one row per window and task."""
    return rows.groupBy("symbol", F.window("ts", every).alias("w")).agg(*_merges()).select("symbol", F.col("w.start").alias("ts"), *_STATE)


def resampled(rows: DataFrame, every: str) -> DataFrame:
    """Candles and mean volatility over windows that are multiples of the states' own."""
    wide = merged(rows, every)
    return wide.select("symbol", "ts", "open", "high", "low", "close", "volume", (F.col("volatility_sum") / F.col("n")).alias("volatility"))


def window_means(rows: DataFrame, every: str) -> DataFrame:
    """Mean volatility per symbol and window, labelled by the window's end as points.windowed_mean does."""
    end = F.col("ts") + F.expr(f"INTERVAL {every}")
    return resampled(rows, every).select("symbol", end.alias("window_end"), "volatility")


def refresh(store: MarketStore, changed: DataFrame | None, batch_id: int) -> None:
    """Bring the rollups up to the log of candles after a batch wrote (symbol, ts): new candles, late ones and corrections.

    Without `changed`, what changed is what the log holds of that batch, and nothing but the log is read.

    Only days with a changed candle are read, and of those only dirty windows are written. A batch refreshed again replaces its own rows.
    The candles move once, by the windows of the second width: last writes are taken there, and the states of both widths built. A hot symbol
    has as many of those windows as its days hold. The widest states are merged from the narrowest, which are at hand for whole days.
    """
    if changed is None:
        days = store.batch_days("candles", batch_id)
    else:
        days = [r.day for r in changed.select(F.to_date("ts").alias("day")).distinct().collect()]  # as many as the batch has days
    if not days:
        return

    def append(table: str, built: DataFrame) -> None:
        rows = built.where(F.col("dirty") & (F.col("n") > 0)).withColumn("arrival", arrival(batch_id, F.lit(0).cast("bigint")))
        store.append(table, rows, batch_id, utc_day("ts"))

    (first, narrow), (second, wide), (third, widest) = LEVELS
    # Every window lies within one day, so its candles are in the days that are read.
    candles = store.log("candles", min(days), max(days)).where(F.col("day").isin(days))
    own = (F.col("writer") == "main") & (F.col("batch_id") == batch_id) if changed is None else F.lit(False)
    candles = candles.withColumns({"held": F.lit(True), "dirty": own}).drop("day", "writer", "batch_id")
    last = _last_by_window(candles, changed, wide)
    # A change that the log has no candle of counts for nothing but its windows.
    single = _singles(last, "within", "dirty", "held").withColumns({c: F.when(F.col("held"), F.col(c)) for c in ("n", "open_ts", "close_ts")})
    by_window = single.withColumn("ts", _start("ts", narrow)).groupBy("symbol", "within", "ts")
    built = by_window.agg(*_merges(), F.max("dirty").alias("dirty")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        append(first, built)
        append(second, _whole_windows(built))
        append(third, _whole_windows(built.withColumn("within", _start("ts", widest))))
    finally:
        built.unpersist()


def _last_by_window(rows: DataFrame, changed: DataFrame | None, every: str) -> DataFrame:
    """The last write of each (symbol, ts) as `held`, and what changed as `dirty`, dealt by `within`, the start of their window."""
    values = [F.max_by(c, "arrival").alias(c) for c in rows.columns if c not in ("symbol", "ts", "arrival", "held", "dirty")]
    if changed is not None:
        marks = changed.select("symbol", "ts", F.lit(False).alias("held"), F.lit(True).alias("dirty"))
        rows = rows.unionByName(marks, allowMissingColumns=True)
    dealt = rows.where(F.col("symbol").isNotNull()).withColumn("within", _start("ts", every)).repartition("symbol", "within")
    return dealt.groupBy("symbol", "within", "ts").agg(*values, F.max("held").alias("held"), F.max("dirty").alias("dirty"))


def _whole_windows(rows: DataFrame) -> DataFrame:
    """One state for each symbol and `within`."""
    return rows.groupBy("symbol", "within").agg(*_merges(), F.max("dirty").alias("dirty")).withColumnRenamed("within", "ts")
