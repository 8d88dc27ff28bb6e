"""Time helpers. Sessions run in UTC (see session.configure)."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

DEFAULT_ZONE = "US/Eastern"


def moment(value: datetime | date | str) -> datetime:
    """An as-of argument as a naive UTC datetime."""
    if isinstance(value, str):
        return datetime.fromisoformat(value)
    if isinstance(value, datetime):
        return value
    return datetime(value.year, value.month, value.day)


def literal(value: datetime, kind: DataType | str) -> Column:
    """A foldable time literal of the given type, so comparisons with it reach the scan."""
    return F.lit(value.isoformat(sep=" ")).cast(kind)


def like(value: datetime | str, df: DataFrame, column: str) -> Column:
    """A time literal of the same type as a column (with or without time zone)."""
    return literal(moment(value), df.schema[column].dataType)


def hours_before(as_of: datetime | str, hours: float) -> datetime:
    return moment(as_of) - timedelta(hours=hours)


def days_before(as_of: datetime | str, days: float) -> datetime:
    return moment(as_of) - timedelta(days=days)


def in_span(points: DataFrame, start: datetime, stop: datetime, ts: str = "ts") -> Column:
    """start <= ts < stop. Where the table is partitioned by day, whole days are pruned as well."""
    time = F.col(ts)
    inside = (time >= like(start, points, ts)) & (time < like(stop, points, ts))
    if "day" in points.columns:
        inside &= F.col("day").between(day_literal(start), day_literal(stop))
    return inside


def day_literal(value: datetime) -> Column:
    return F.lit(value.date().isoformat()).cast("date")


def date_bucket(ts: Column) -> Column:
    """The UTC day as text."""
    return F.to_date(ts).cast("string")


def epoch_seconds_or(seconds: Column, fallback: Column) -> Column:
    """Positive epoch seconds as a timestamp, else the fallback."""
    return F.coalesce(F.when(seconds > 0, F.timestamp_seconds(seconds)), fallback)


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names the running JVM resolves; an unknown name would fail the whole job."""
    java = spark._jvm.java
    # Joined in the JVM: fetching some six hundred names one by one takes longer than a query.
    return sorted(java.lang.String.join(" ", java.time.ZoneId.getAvailableZoneIds()).split())


def zone_or_default(zone: Column, known: list[str], default: str = DEFAULT_ZONE) -> Column:
    """The zone where it is a known name or a plain offset, else the default (also for null)."""
    offset = zone.rlike(r"^(UTC|GMT|UT)?[+-](0[0-9]|1[0-7]):[0-5][0-9]$")
    return F.when(zone.isin(known) | offset, zone).otherwise(F.lit(default))


def local_to_utc(text: Column, pattern: str, zone: Column) -> Column:
    """Local wall-clock text in a zone to an instant; null where the text does not parse."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone)


def observation_midnight(text: Column) -> Column:
    """Strict yyyy-MM-dd text to its midnight; null otherwise."""
    return F.when(
        text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    )


def observation_date(text: Column, last_ts: Column, as_of: datetime | str) -> Column:
    """Parsed date, else the day of the last timestamp, else the as-of day."""
    return F.coalesce(
        F.to_date(observation_midnight(text)),
        F.to_date(last_ts),
        F.lit(moment(as_of).date().isoformat()).cast("date"),
    )


def in_market_hours(ts: Column, zone: str = DEFAULT_ZONE) -> Column:
    """Monday to Friday, 09:30 up to 16:00 on the exchange's clock."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return F.weekday(local).between(0, 4) & (minute >= 9 * 60 + 30) & (minute < 16 * 60)
