"""Token counts through a digest cache.

A count belongs to a text's digest and to its tokenizer's. Stored counts are joined to the texts' digests; of the texts that have none, each
distinct one is encoded once (a row repeated with its id, as often as that), and its count appended to the cache, which then answers for every row. A later run with
the same tokenizer encodes new texts only; another tokenizer file, or another version of its library, is another tokenizer.

Texts travel once, to be joined with the list of those to encode; digests and counts are small rows. The normal form of a text
that the digest is made from changes nothing but null, which is empty: any further change could change the count.

The cache is a folder of Parquet files. Appending commits like any Spark write. Writers at the same time, or a run that is
repeated, may store a count twice; readers take one of them, as they are equal.

Defined results: null and empty texts have 0 bytes and 0 tokens. Rows keep their number; repeated rows and null ids get their own answers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.segments import byte_tokenizer
from tapewright.llm.tables import whole_texts

SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer: its file, and its library's version."""
    with open(path, "rb") as file:
        content = file.read()
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(content + f"\0{library} {version(library)}".encode()).hexdigest()


def counter(path: str) -> Callable[[list], list[int]]:
    """Counts of texts, without special tokens: the tokenizers library for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        from tapewright.llm.pieces import piece_encoder

        pieces = piece_encoder(path)
        return lambda texts: [len(ids) // 4 for ids, _ in pieces.encode(texts)]
    tokenizer = byte_tokenizer(path)
    return lambda texts: [len(ids) // 4 for ids in tokenizer.encode(texts)]


def stored_counts(spark, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) in the cache, one row for each digest; none if there is no cache yet."""
    try:
        found = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], SCHEMA)
    return found.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document; new counts are appended to the cache."""
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(tokenizer_path)
    texts = whole_texts(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    # One row stands for each digest without a count; digests meet before any text moves.
    wanted = keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    wanted = wanted.join(stored_counts(spark, cache, tokenizer), "digest", "left_anti")
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["digest"] == wanted["digest"])
    misses = texts.join(wanted, same, "left_semi")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in batches:
            counts = pa.array(count(batch["text"].to_pylist()), pa.int64())
            names = pa.array([tokenizer] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([names, batch["digest"], counts], ["tokenizer", "digest", "n_tokens"])

    misses.select("digest", "text").mapInArrow(encoded, SCHEMA).write.mode("append").parquet(cache)
    return keys.join(stored_counts(spark, cache, tokenizer), "digest").select("doc_id", "n_bytes", "n_tokens")
