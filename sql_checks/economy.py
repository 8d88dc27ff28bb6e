"""Economic observations, summaries and metadata."""

from pyspark.sql import functions as F

from sql_checks import base
from sql_checks.base import AS_OF, check
from tapewright.operators.ranking import page_info
from tapewright.plans import economy


@check(
    "economic_parse",
    """
    SELECT series_id, observation_date, CAST(raw_value AS DOUBLE) AS value, seq AS arrival FROM economic
    WHERE raw_value NOT IN ('.', 'n/a')""",
    "economic",
)
def economic_parse(spark, folder):
    parsed = economy.parse_observations(base.economic(spark, folder))
    return parsed.where(F.col("reason").isNull()).select("series_id", "observation_date", "value", "arrival")


@check(
    "economic_rejects",
    """
    SELECT series_id, CASE raw_value WHEN '.' THEN 'no_observation' ELSE 'value_not_a_number' END AS reason, count(*) AS n
    FROM economic WHERE raw_value IN ('.', 'n/a') GROUP BY 1, 2""",
    "economic",
)
def economic_rejects(spark, folder):
    parsed = economy.parse_observations(base.economic(spark, folder))
    return parsed.where(F.col("reason").isNotNull()).groupBy("series_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@check("economic_points", " SELECT series_id, ts, value FROM observations", "observations")
def economic_points(spark, folder):
    """Rewrites of one (series, date) resolved to the last arrival."""
    return base.observations(spark, folder).select("series_id", "ts", "value")


_RESPONSE = """i.indicator AS series_id, i.observation_date, i.latest_value AS value,
      i.observation_date AS real_time_start, i.observation_date AS real_time_end, m.title, m.frequency, m.units, m.notes, m.source"""
_JOINED = "indicators i LEFT JOIN metadata m ON upper(i.indicator) = m.series_id"


@check("indicator_summary_join", f" SELECT {_RESPONSE} FROM {_JOINED}", "indicators", "metadata")
def indicator_summary_join(spark, folder):
    return economy.indicator_summaries(base.indicators(spark, folder), base.metadata(spark, folder), AS_OF)


@check(
    "indicator_lookup", f" SELECT {_RESPONSE} FROM {_JOINED} WHERE i.indicator = 'CLICK'", "indicators", "metadata"
)
def indicator_lookup(spark, folder):
    return economy.indicator(base.indicators(spark, folder), base.metadata(spark, folder), "click", AS_OF)


@check(
    "indicator_page",
    f""" SELECT {_RESPONSE}, 1 AS page, 2 AS size, (SELECT count(*) FROM indicators) AS total_elements,
      CAST(ceil((SELECT count(*) FROM indicators) / 2::DOUBLE) AS INT) AS total_pages,
      1 < CAST(ceil((SELECT count(*) FROM indicators) / 2::DOUBLE) AS INT) - 1 AS has_next, true AS has_previous
    FROM {_JOINED} ORDER BY i.indicator LIMIT 2 OFFSET 2""",
    "indicators",
    "metadata",
)
def indicator_page(spark, folder):
    return economy.indicator_page(base.indicators(spark, folder), base.metadata(spark, folder), AS_OF, 1, 2)


@check(
    "indicator_timeseries",
    f""" SELECT series_id, value, ts FROM observations WHERE series_id = 'VIEW'
      AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAYS AND ts < TIMESTAMP '{AS_OF}'""",
    "observations",
)
def indicator_timeseries(spark, folder):
    return economy.indicator_timeseries(base.observations(spark, folder), "view", AS_OF, days=20)


@check(
    "indicator_observations",
    """ SELECT o.series_id, o.ts, o.value, m.title, m.frequency, m.units, m.notes, m.source
    FROM (SELECT * FROM observations WHERE series_id = 'PURCHASE' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
      ORDER BY ts DESC LIMIT 12) o LEFT JOIN metadata m ON o.series_id = m.series_id""",
    "observations",
    "metadata",
)
def indicator_observations(spark, folder):
    return economy.indicator_observations(
        base.observations(spark, folder), base.metadata(spark, folder), "purchase", "2024-01-05", "2024-01-25", limit=12
    )


@check(
    "indicator_latest_n",
    """ SELECT series_id, ts, value FROM observations
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 10""",
    "observations",
)
def indicator_latest_n(spark, folder):
    return economy.newest_observations(base.observations(spark, folder), 10).select("series_id", "ts", "value")


@check(
    "metadata_insert_if_absent",
    """ SELECT s.series_id, s.title FROM
      (SELECT DISTINCT series_id, concat('Series ', series_id) AS title FROM economic
        WHERE series_id IN ('CLICK', 'ERROR', 'SIGNUP', 'VIEW')) s
    WHERE s.series_id NOT IN (SELECT series_id FROM metadata)""",
    "economic",
    "metadata",
)
def metadata_insert_if_absent(spark, folder):
    """Of four described series those not yet in the table; series without a description drop out."""
    names = ("CLICK", "ERROR", "SIGNUP", "VIEW", "UNSEEN")
    known = spark.createDataFrame([(n, f"Series {n}") for n in names], "series_id string, title string")
    return economy.missing_metadata(base.economic(spark, folder), known, base.metadata(spark, folder))


@check("indicator_page_info", """ SELECT 4 AS page, 2 AS size, count(*) AS total_elements, CAST(ceil(count(*) / 2::DOUBLE) AS INT) AS total_pages,
      4 < CAST(ceil(count(*) / 2::DOUBLE) AS INT) - 1 AS has_next, true AS has_previous FROM indicators""", "indicators")
def indicator_page_info(spark, folder):
    return page_info(base.indicators(spark, folder), 4, 2)
