"""Ordered work on long series without putting a series into one task.

A plain window over a symbol hands that symbol's whole history to one task. Here rows are worked on
inside time buckets, and only a few rows per symbol and bucket, bounded by the calendar, are carried
from bucket to bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tapewright.operators.ranking import check_page, with_page_info


def _bucket(ts: str, grain: str) -> Column:
    return F.date_trunc(grain, F.col(ts))


def bucket_starts(df: DataFrame, key: str, ts: str, grain: str, descending: bool = False) -> DataFrame:
    """(key, bucket, rows in it, rows before it, rows of the key), from a map-side combined count."""
    counts = df.groupBy(key, _bucket(ts, grain).alias("__bucket")).agg(F.count(F.lit(1)).alias("__rows"))
    order = F.desc("__bucket") if descending else F.asc("__bucket")
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns(
        {
            "__before": F.coalesce(F.sum("__rows").over(before), F.lit(0)),
            "__total": F.sum("__rows").over(Window.partitionBy(key)),
        }
    )


def with_position(
    df: DataFrame, key: str, ts: str, name: str = "position", grain: str = "hour", tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Zero-based position of each row in its key's whole series, by ts and then the tiebreak."""
    starts = bucket_starts(df, key, ts, grain).select(key, "__bucket", "__before")
    inside = Window.partitionBy(key, "__bucket").orderBy(ts, *tiebreak)
    numbered = df.withColumn("__bucket", _bucket(ts, grain)).withColumn("__rank", F.row_number().over(inside))
    return (
        numbered.join(starts, [key, "__bucket"])
        .withColumn(name, F.col("__before") + F.col("__rank") - 1)
        .select(*df.columns, name)
    )


def trailing_rows(
    df: DataFrame, key: str, ts: str, rows: int, aggregates: Mapping[str, Column], grain: str = "day"
) -> DataFrame:
    """Aggregates over each row and the rows-1 rows before it in its key. (key, ts) is unique.

    Windows run inside time buckets. That is final for all rows but the first rows-1 of a bucket,
    the heads. The rows before a head are other heads and the last rows-1 rows of earlier buckets,
    so a second window over heads and tails alone settles them. It sees at most 2 * (rows-1) rows of
    a key per bucket. Both branches read the same shuffle of the rows.

    A bucket should hold many more rows than the window and still fit a task: days suit candles of a
    minute, hours suit ticks.
    """
    if rows < 1:
        raise ValueError("rows must be positive")
    lead = rows - 1
    bucket = Window.partitionBy(key, "__bucket")
    inside, across = bucket.orderBy(ts), Window.partitionBy(key).orderBy(ts)
    placed = df.withColumn("__bucket", _bucket(ts, grain)).withColumns(
        {"__rank": F.row_number().over(inside), "__size": F.count(F.lit(1)).over(bucket)}
    )
    head = F.col("__rank") <= lead
    tail = F.col("__rank") > F.col("__size") - lead

    def added(window: WindowSpec) -> dict[str, Column]:
        return {name: aggregate.over(window.rowsBetween(-lead, 0)) for name, aggregate in aggregates.items()}

    inner = placed.withColumns(added(inside)).where(~head)
    edges = placed.where(head | tail).withColumns(added(across)).where(head)
    return inner.select(*df.columns, *aggregates).unionByName(edges.select(*df.columns, *aggregates))


def page_of_series(df: DataFrame, key: str, ts: str, page: int, size: int, grain: str = "hour") -> DataFrame:
    """One page of one key's history, newest first, with the page envelope.

    Only the buckets that overlap the page are read for rows; skipped rows are counted, not sorted.
    `df` holds a single key. Rows of equal time come in the order of their other columns, so that pages neither repeat nor lose one.
    """
    check_page(page, size)
    first, last = page * size, (page + 1) * size
    starts = bucket_starts(df, key, ts, grain, descending=True)
    wanted = starts.where((F.col("__before") < last) & (F.col("__before") + F.col("__rows") > first))
    inside = Window.partitionBy(key, "__bucket").orderBy(F.desc(ts), *(c for c in df.columns if c not in (key, ts)))
    return (
        df.withColumn("__bucket", _bucket(ts, grain))
        .join(wanted.select(key, "__bucket", "__before", "__total"), [key, "__bucket"])
        .withColumn("__pos", F.col("__before") + F.row_number().over(inside) - 1)
        .where((F.col("__pos") >= first) & (F.col("__pos") < last))
        .select(*df.columns, "__total")
        .withColumns(with_page_info(F.col("__total"), page, size))
        .drop("__total")
    )
