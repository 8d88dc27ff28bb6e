"""Request, quota and alert statistics."""

from pyspark.sql import functions as F

from sql_checks import base
from sql_checks.base import AS_OF, check
from tapewright.operators import quality


@check(
    "request_stats",
    f"""
    SELECT service, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures,
      round(count(*) FILTER (ok) * 100.0 / count(*), 6)::DOUBLE AS success_rate,
      CAST(coalesce(epoch(TIMESTAMP '{AS_OF}')::BIGINT - floor(epoch(max(ts) FILTER (ok)))::BIGINT, -1) AS BIGINT) AS seconds_since_success,
      count(*) AS calls
    FROM requests GROUP BY 1""",
    "requests",
)
def request_stats(spark, folder):
    return base.rounded(quality.request_stats(base.requests(spark, folder), AS_OF), "success_rate")


@check(
    "quota_usage",
    """
    SELECT service, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, greatest(25 - count(*), 0) AS remaining,
      count(*) >= 25 AS quota_reached
    FROM requests GROUP BY 1, 2""",
    "requests",
)
def quota_usage(spark, folder):
    usage = quality.quota_usage(base.requests(spark, folder))
    return usage.withColumn("day", F.col("day").cast("string"))


@check(
    "hourly_usage",
    " SELECT service, date_trunc('hour', ts)::TIMESTAMP AS hour_start, count(*) AS calls FROM requests GROUP BY 1, 2",
    "requests",
)
def hourly_usage(spark, folder):
    return quality.hourly_usage(base.requests(spark, folder))


def failures(spark, folder):
    """Failed requests as dead letters of their service."""
    failed = base.requests(spark, folder).where(F.col("ok") == 0)
    return failed.select(F.col("service").alias("source"), F.col("ts").alias("rejected_at"))


_WINDOWS = """
      SELECT service AS source, minute + to_minutes(k) AS window_end, sum(n)::BIGINT AS rejects
      FROM (SELECT service, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM requests WHERE NOT ok GROUP BY 1, 2),
        (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY 1, 2"""


@check("invalid_rate_windows", f" SELECT *, rejects / 300.0::DOUBLE AS rate FROM ({_WINDOWS})", "requests")
def invalid_rate_windows(spark, folder):
    windows = quality.rejection_windows(failures(spark, folder))
    return windows.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@check(
    "invalid_rate_alerts",
    f""" SELECT source, window_end, rejects, rejects / 300.0::DOUBLE AS rate FROM (SELECT *, count(*) OVER (PARTITION BY source ORDER BY window_end
        RANGE BETWEEN INTERVAL 4 MINUTES PRECEDING AND CURRENT ROW) AS held FROM ({_WINDOWS})) WHERE held >= 5""",
    "requests",
)
def invalid_rate_alerts(spark, folder):
    """Any dead letter at all counts as too many here: the supplied log is sparse."""
    alerts = quality.rejection_alerts(quality.rejection_windows(failures(spark, folder)), threshold=0.003)
    return alerts.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))
