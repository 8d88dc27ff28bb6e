"""Packing by powers of two: every document is split into pieces of binary length, and pieces of one length form a bucket.

A document's ids, with the end id, are cut from the front into as many pieces of the longest length as fit, and the rest by
the binary digits of its length, longest first. Every piece is a sequence of its own, at offset 0 and without padding, so no sequence
crosses documents; a batch is drawn from one bucket. The sequence id holds the length's exponent in its highest bits, then
a number unique in the run: sequences of one length are one range of ids.

No row moves between tasks; a lost task is repeated over its own input and gives the same rows.

Defined results: a null or empty text has the end id alone, one piece of length 1. Repeated rows and null ids are packed row by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.segments import byte_tokenizer
from tapewright.llm.tables import whole_texts

LONGEST = 2048
END = 1
#: Bits below the exponent in a sequence id: 26 for the task, 33 for its row.
BELOW = 59


def binary_pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; `longest` is a power of two."""
    pieces = [(start, longest) for start in range(0, n - longest + 1, longest)]
    start = len(pieces) * longest
    while start < n:
        length = 1 << ((n - start).bit_length() - 1)
        pieces.append((start, length))
        start += length
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset of every piece."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest sequence has to be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for key, ids in zip(batch["doc_id"].to_pylist(), tokenizer.encode(batch["text"].to_pylist())):
                ids += last
                total = len(ids) // 4
                for start, length in binary_pieces(total, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((key, start, length, zlib.crc32(piece), total) + ((np.frombuffer(piece, "<i4"),) if with_ids else ()))
                if len(rows) >= 20_000:
                    yield _batch(rows, with_ids)
                    rows = []
            if rows:
                yield _batch(rows, with_ids)

    pieces = whole_texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)
    exponent = F.log2(F.col("length")).cast("long")
    return pieces.withColumns(
        {
            "sequence_id": F.shiftleft(exponent, BELOW) + F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length; a folder's files hold sequences of that length only."""
    packed.hint("rebalance", "length").write.partitionBy("length").parquet(path)
