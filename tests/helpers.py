"""Small helpers shared by the tests."""

from datetime import datetime

from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def at(text):
    return datetime.fromisoformat(text)


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def rows(df, *columns):
    """The rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def values(spark, column, schema, data):
    """A column expression evaluated over literal rows, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column.alias("v")).collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def times(df, *columns):
    """Timestamps as text, so that tests do not depend on the driver's clock zone."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})
