"""Exact top-k by inner product, term at a time.

A vector is a sparse row of integer weights; a dimension is a term. Rows meet queries in blocks: a task holds one block of candidates as
postings (for each term the rows that have it, with their weights) and one block of queries. For every term of a query its
weight times the postings is scattered into a dense array with a score for each candidate; the k best are picked by
partition selection and sorted; blocks' lists are merged by query, cut to k in every task before they move.

Blocks are of a fixed size, so a task's memory does not grow with the table. The work is queries x rows, as exhaustive search is; rows
are sent once for each block of queries.

Defined results: vectors that are null, or hold a null or a component that is not finite, and rows without an id, take no part. Scores are 64-bit
integers; a component's weight must keep them in range. Vectors of unlike length are compared on the terms both have. Ties go to the
smaller id. Of rows with one id the smallest vector is the query, and none of them is its candidate; each is one for others.
A query with fewer candidates than k gets all of them, one without any gets no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192
QUERIES = 2048


def weights(vector: Column, scale: int) -> Column:
    """floor(scale * component) of every component; null for a vector that takes no part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def postings(rows: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term, the rows that have it and their weights; all rows as a slice."""
    lists = []
    for term in range(rows.shape[1]):
        at = np.flatnonzero(rows[:, term])
        place = slice(None) if len(at) == len(rows) else at
        lists.append((place, np.ascontiguousarray(rows[place, term])))
    return lists


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, vector in enumerate(vectors):
        out[i, : len(vector)] = vector
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score over (vec_id, weights); `is_query` picks the queries, all rows are candidates."""
    rows = vectors.where(F.col("weights").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "weights")
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("weights").alias("weights"))
    n_rows, n_asked = rows.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n_rows // candidates)), max(1, -(-n_asked // queries))

    def block(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(n)), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.select("query_id", "weights", block("query_id", query_blocks).alias("q"), each(row_blocks).alias("c"))
    # Repeated rows spread by content and number, not by id alone.
    placed = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(row_blocks)).cast("int")
    right = rows.withColumn("c", placed).select("vec_id", "weights", "c", each(query_blocks).alias("q"))

    def scan(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(wanted) and len(held):
            width = max(wanted["weights"].map(len).max(), held["weights"].map(len).max())
            ids, lists = held["vec_id"].to_numpy(), postings(_matrix(held["weights"], width))
            for query, row in zip(wanted["query_id"].to_numpy(), _matrix(wanted["weights"], width)):
                scores = np.zeros(len(ids), np.int64)
                for term in np.flatnonzero(row):
                    place, values = lists[term]
                    scores[place] += row[term] * values
                at = best(scores, ids, ids != query, k)
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": scores[at]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    keys = ["q", "c"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
