"""Value at risk and its conditional form over returns of any number: intraday ones, one hot symbol's, or the whole market's.

A key's returns never meet in one task. They are counted in cells of a fixed relative width; such counts are sums, so those of days and symbols
merge into any span or grouping. An order statistic is then located in three steps, cell, part of the cell, value: each
counts only the rows of the place found so far, combined in every task, and a window runs over the counts of one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.series import trailing_rows

LEVELS = (0.05, 0.01)
#: A cell's bounds differ by 2 %; returns up to SMALLEST share a cell with those of their sign.
RATIO = 1.02
SMALLEST = 1e-12
#: Parts of a cell, by its own least and greatest value.
PARTS = 4096


def bar_returns(bars: DataFrame, grain: str = "day") -> DataFrame:
    """The bars that have one before them in their symbol, with ret = close / previous close - 1. (symbol, ts) is unique."""
    before = {"__first": F.first("close"), "__bars": F.count(F.lit(1))}
    rows = trailing_rows(bars, "symbol", "ts", 2, before, grain).where(F.col("__bars") == 2)
    return rows.withColumn("ret", F.try_divide("close", "__first") - 1).drop("__first", "__bars").where(F.col("ret").isNotNull())


def cell(value: Column) -> Column:
    """Number of the value's cell, in the order of values."""
    steps = F.floor(F.log(F.greatest(F.abs(value), F.lit(SMALLEST)) / SMALLEST) / F.log(F.lit(RATIO)))
    return (F.signum(value) * (steps + 1)).cast("int")


def cell_states(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number, sum and extremes of the returns of each key and cell."""
    values = (F.col("ret").alias(c) for c in ("total", "low", "high"))
    single = returns.select(*keys, cell(F.col("ret")).alias("cell"), F.lit(1).cast("bigint").alias("n"), *values)
    return merged_cells(single, keys)


def merged_cells(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of a wider grouping from those of a narrower one."""
    sums = (F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    return states.groupBy(*keys, "cell").agg(*sums)


def _located(targets: DataFrame, counts: DataFrame, place: Sequence[str], step: str, *carried: str) -> DataFrame:
    """Each target's `step` within its place: the one whose rows, in order, hold its rank; the rank goes on within it."""
    order = Window.partitionBy(*place).orderBy(step)
    ends = counts.withColumn("__end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = targets.join(ends.select(*place, step, "n", "__end", *carried), [*place])
    start = F.col("__end") - F.col("n")
    held = held.where((F.col("rank") >= start) & (F.col("rank") < F.col("__end"))).withColumn("rank", F.col("rank") - start)
    return held.drop("n", "__end")


def tail_figures(returns: DataFrame, keys: Sequence[str], levels: Sequence[float] = LEVELS, states: DataFrame | None = None) -> DataFrame:
    """Per key: observations, and var_<confidence> and cvar_<confidence> for each level (var_95 for 0.05).

    The cut is the level's interpolated percentile; var is minus the cut, cvar minus the mean of the returns at or below it. `states` are
    the key's cells, merged from stored ones, of the same returns; without them they are counted here. Returns that are null or not
    finite are left out; a key without any has no row. Keys come from the data: a literal would leave the small joins without a key.
    Repeated and equal returns count as often as they occur.
    """
    keys = list(keys)
    returns = returns.where(F.abs("ret") < F.lit(float("inf"))).select(*keys, "ret", cell(F.col("ret")).alias("cell"))
    states = cell_states(returns, keys) if states is None else states
    whole = states.groupBy(*keys).agg(F.sum("n").alias("observations"))
    place = F.col("level") * (F.col("observations") - 1)
    targets = whole.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("part", place - F.floor(place))
    targets = targets.withColumn("rank", F.explode(F.array(F.floor(place), F.ceil(place))))
    # Both neighbours of a place that is a whole number are the same row, once is enough.
    targets = targets.distinct().withColumn("side", F.col("rank"))
    targets = _located(targets, states, keys, "cell", "low", "high")

    own = [*keys, "cell"]
    near = returns.join(targets.select(*own, "low", "high").distinct(), own)
    share = F.coalesce(F.try_divide(F.col("ret") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    near = near.withColumn("piece", F.floor(share * PARTS)).drop("low", "high")
    counts = near.groupBy(*own, "piece").agg(F.count(F.lit(1)).alias("n"))
    targets = _located(targets.drop("low", "high"), counts, own, "piece")

    own = [*own, "piece"]
    counts = near.join(targets.select(*own).distinct(), own, "left_semi").groupBy(*own, "ret").agg(F.count(F.lit(1)).alias("n"))
    targets = _located(targets, counts, own, "ret")
    low, high = F.min_by("ret", "side"), F.max_by("ret", "side")
    cuts = targets.groupBy(*keys, "observations", "level").agg((low + (high - low) * F.first("part")).alias("cut"))
    cuts = cuts.withColumn("cell", cell(F.col("cut")))

    # What lies in lower cells is known by its sums; only the cut's own cell is read again.
    within = cuts.withColumnRenamed("cell", "cut_cell")
    below = within.join(states, keys).where(F.col("cell") < F.col("cut_cell")).select(*keys, "level", "n", "total")
    beside = returns.join(cuts, [*keys, "cell"]).where(F.col("ret") <= F.col("cut"))
    beside = beside.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"))
    tail = below.unionByName(beside).groupBy(*keys, "level").agg((F.sum("total") / F.sum("n")).alias("mean"))
    figures = cuts.join(tail, [*keys, "level"]).groupBy(*keys, "observations")
    chosen = [(level, f"{100 * (1 - level):g}") for level in levels]
    pick = lambda column, level: -F.max(F.when(F.col("level") == level, F.col(column)))
    return figures.agg(*(pick("cut", v).alias(f"var_{n}") for v, n in chosen), *(pick("mean", v).alias(f"cvar_{n}") for v, n in chosen))
