"""Dead letters: what was refused, by whom, why and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.text import truncate



def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason").isNull()).drop("reason", "payload")


def rejected(classified: DataFrame, source: str, record_type: str, rejected_at: Column, data: str = "payload") -> DataFrame:
    """Refused rows as dead letters with their whole data, so that they can be mended and replayed."""
    return classified.where(F.col("reason").isNotNull()).select(
        F.lit(source).alias("source"),
        F.lit(record_type).alias("record_type"),
        "reason",
        rejected_at.cast("timestamp").alias("rejected_at"),
        F.col(data).cast("string").alias("data"),
    )


def shown(letters: DataFrame, length: int = 500) -> DataFrame:
    """Dead letters for people: the first characters of their data."""
    return letters.withColumn("data", truncate(F.col("data"), length))
