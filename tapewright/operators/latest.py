"""Latest row per key and insert-if-absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, NumericType, BooleanType, DateType, TimestampType, TimestampNTZType

_FIXED_WIDTH = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


def _fixed_width(kind: DataType) -> bool:
    return isinstance(kind, _FIXED_WIDTH) and not isinstance(kind, DecimalType)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is greatest by the order columns.

    Both forms are plain aggregations: every task reduces its own rows to one per key before the
    shuffle, so a key that holds a third of all rows costs no more than any other. Full ties fall
    to the greatest remaining columns, which keeps the result the same on every run.
    """
    payload = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *payload)).alias("__latest")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col(f"__latest.`{c}`").alias(c) for c in [*order, *payload])).select(*df.columns)


def latest_by_unique(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """As latest_per_key where no two rows of a key share the order value.

    With fixed-width columns only, the aggregation runs in a hash map instead of sorting its input.
    """
    payload = [c for c in df.columns if c not in keys and c != order]
    if not all(_fixed_width(df.schema[c].dataType) for c in [order, *payload]):
        return latest_per_key(df, keys, [order])
    picks = [F.max_by(c, order).alias(c) for c in payload]
    return df.groupBy(*keys).agg(F.max(order).alias(order), *picks).select(*df.columns)


def insert_if_absent(existing: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The candidate rows whose key is not in the existing table."""
    return candidates.join(existing.select(key), key, "left_anti")
