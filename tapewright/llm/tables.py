"""Helpers the text operators share: reading, folds, tables that cut lineage, results of Python column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.session import shared_folder

#: Name of the column that holds a Python function's result beside a table's own columns.
ADDED = "__tapewright_added"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """Fold of a row by its id; null for a null id."""
    return F.crc32(key.cast("string")) % folds


def whole_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row, whole; a null text is empty. Other columns are left behind."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, kept when executors are lost."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_sample(df: DataFrame, key: Column, rows: int, group: str | None = None) -> DataFrame:
    """At most `rows` rows (of each group), chosen by a hash of their key; the same rows on every run."""
    from pyspark.sql import Window

    if group is None:
        return df.orderBy(F.xxhash64(key), key).limit(rows)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key))
    return df.withColumn(ADDED, place).where(F.col(ADDED) <= rows).drop(ADDED)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside fold 0.

    The ids are chosen from the labels alone, so the broadcast side has `rows` rows at most and texts are not shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = small_sample(known, F.col("doc_id"), rows)
    texts = whole_texts(docs).join(F.broadcast(chosen), "doc_id")
    # A repeated id would bring all its rows; one of them is enough.
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def scored(docs: DataFrame, function: Callable[..., Column], *columns: Column) -> DataFrame:
    """Every column of the table and the function's struct in ADDED."""
    return docs.withColumn(ADDED, function(*columns))


def kept(docs: DataFrame, accepts: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose text is accepted, with their own columns; accepts() makes a task's judge of a text.

    Record batches are filtered as they are: no row waits beside the worker for its verdict, and what a batch took is given back.
    """
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = accepts()
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py()) for t in batch.column(at)], pa.bool_()))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(rows, docs.schema)
