"""Deep pages of large tables by an order-statistic index: sorted range buckets and how many rows each has.

    <path>/rows/bucket=B/    the rows between two bounds of the order, sorted
    <path>/counts/           rows of each bucket
    <path>/columns/          the table's columns, without rows

A page's rows lie in the buckets whose running count meets it; only those are read, whatever the page's number. Bounds come from Spark's
sample of the order, counts are exact. The order has to be total (end it with a key), so that pages neither share nor miss rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tapewright.operators.ranking import check_page, with_page_info

BUCKET_ROWS = 100_000


def write_index(rows: DataFrame, order: Sequence[str], path: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """Write the rows in the order given as SQL sort terms, such as ("change DESC NULLS LAST", "symbol")."""
    terms = [_term(t) for t in order]
    buckets = max(1, -(-rows.count() // bucket_rows))
    dealt = rows.repartitionByRange(buckets, *terms).withColumn("bucket", F.spark_partition_id())
    dealt.sortWithinPartitions("bucket", *terms).write.partitionBy("bucket").parquet(f"{path}/rows")
    schema = StructType([*rows.schema.fields, StructField("bucket", IntegerType())])
    rows.limit(0).write.parquet(f"{path}/columns")
    counts = rows.sparkSession.read.schema(schema).parquet(f"{path}/rows").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, order: Sequence[str], page: int, size: int) -> DataFrame:
    """One page with its envelope, in order; no row beyond the end."""
    check_page(page, size)
    # One row for each bucket: as many as the table has multiples of the bucket size.
    counts = sorted(tuple(r) for r in spark.read.schema("bucket int, n long").parquet(f"{path}/counts").collect())
    total, first, chosen, before = sum(n for _, n in counts), page * size, [], 0
    skipped = 0
    for bucket, n in counts:
        if before + n <= first:
            skipped = before + n
        elif before < first + size:
            chosen.append(bucket)
        before += n
    columns = spark.read.parquet(f"{path}/columns").schema
    rows = spark.createDataFrame([], columns)
    if chosen:
        rows = spark.read.schema(columns).parquet(*(f"{path}/rows/bucket={b}" for b in chosen))
    rows = rows.orderBy(*(_term(t) for t in order)).offset(first - skipped if chosen else 0).limit(size)
    return rows.withColumns(with_page_info(F.lit(total).cast("bigint"), page, size))


def _term(text: str):
    """A sort term: a column, ASC or DESC, NULLS FIRST or LAST."""
    words = text.split()
    name, rest = words[0], " ".join(words[1:]).upper()
    sorts = {
        "": F.asc, "ASC": F.asc, "DESC": F.desc,
        "ASC NULLS FIRST": F.asc_nulls_first, "ASC NULLS LAST": F.asc_nulls_last, "NULLS FIRST": F.asc_nulls_first, "NULLS LAST": F.asc_nulls_last,
        "DESC NULLS FIRST": F.desc_nulls_first, "DESC NULLS LAST": F.desc_nulls_last,
    }
    if rest not in sorts:
        raise ValueError(f"not a sort term: {text}")
    return sorts[rest](name)
