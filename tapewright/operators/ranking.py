"""Top-k, top-k per key, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Every task keeps n rows; nothing else is sorted or moved."""
    return df.orderBy(*order).limit(n)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every key.

    Spark cuts each task's rows to n per key before the shuffle (WindowGroupLimit), which bounds a
    hot key. It only does so up to a threshold of n; beyond it the cut is made here, in salted
    sub-groups.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        spread = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = df.withColumn("__salt", salt).withColumn("__rank", F.row_number().over(spread))
        df = df.where(F.col("__rank") <= n).drop("__salt", "__rank")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def check_page(page: int, size: int) -> None:
    if page < 0:
        raise ValueError("page must not be negative")
    if size <= 0:
        raise ValueError("size must be positive")


def with_page_info(total: Column, page: int, size: int) -> dict[str, Column]:
    """Envelope columns of a page, from the total row count."""
    pages = F.ceil(total / F.lit(size)).cast("int")
    return {
        "page": F.lit(page),
        "size": F.lit(size),
        "total_elements": total.cast("bigint"),
        "total_pages": pages,
        "has_next": F.lit(page) < pages - 1,
        "has_previous": F.lit(page > 0),
    }


def page_info(df: DataFrame, page: int, size: int) -> DataFrame:
    """The envelope alone, one row; right also for a page beyond the end."""
    check_page(page, size)
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        *(c.alias(name) for name, c in with_page_info(F.col("n"), page, size).items())
    )


def page_of(df: DataFrame, order: Sequence[str], page: int, size: int) -> DataFrame:
    """One page of a per-key summary table, each row carrying the envelope.

    The total comes from a scalar subquery, so no join is made. For long histories of one series
    use series.page_of_series, which does not gather the skipped rows.
    """
    check_page(page, size)
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset(page * size).limit(size)
    return rows.withColumns(with_page_info(total, page, size))

