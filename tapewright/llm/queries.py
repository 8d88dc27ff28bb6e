"""The text operators' queries over the given tables, with production parameters, and SQL where it can express one."""

from __future__ import annotations

import string

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import disclosure, langid, linequality, merkle, neardup, packing, pieces, qualityrules, repeats, search, tokencounts, toxicity, vectorcodes
from tapewright.llm.merkle_sql import merkle_sql
from tapewright.llm.tables import fold, table
from tapewright.session import shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def _held_out(folds: int, own: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), folds) == own, F.lit(False)).alias("held_out")


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded in this run."""
    docs = table(spark, folder, "documents")
    found = tokencounts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_folder(spark, "token-counts"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@query
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.find_personal_data(table(spark, folder, "documents"))


@query
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score", "accepted")


@query
def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = qualityrules.judge(table(spark, folder, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept")


@query
def op3_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", search.weights(F.col("embedding"), 1024).alias("weights"))
    return search.top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE["op3_top_k"] = """
    WITH w AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score,
      CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank
    FROM w q JOIN w c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    QUALIFY rank <= 10"""


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = linequality.score_quality(docs, linequality.fit(docs, table(spark, folder, "labels")))
    return found.select("doc_id", _held_out(5, 0), "score", "predicted", "quality")


@query
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return found.select("doc_id", _held_out(5, 0), "score", "predicted")


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").withColumn("ints", vectorcodes.integers(F.col("embedding")))
    return vectorcodes.compress(vectors).drop("label")


def _codes_sql() -> str:
    """The same rounds by plain assignment; distances and sums are integers held exactly in doubles."""
    distance = "list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x)"
    ctes = ["""kept AS (
      SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS n, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
      """parts AS (SELECT n, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(part))""",
      "b0 AS (SELECT part, n - 1 AS entry, x FROM parts WHERE n <= 64)"]
    for k in range(3):
        ctes.append(f"""a{k} AS (SELECT n, p.part, min(struct_pack(d := {distance}, e := b.entry)) AS best
          FROM parts p JOIN b{k} b USING (part) GROUP BY n, p.part)""")
        if k < 2:
            ctes.append(f"""m{k} AS (SELECT part, entry, list(m ORDER BY place) AS x FROM (
              SELECT part, best.e AS entry, place, floor(sum(x[place]) / count(*)) AS m
              FROM a{k} JOIN parts USING (n, part), range(1, 5) t(place) GROUP BY ALL) GROUP BY ALL)""")
            ctes.append(f"b{k + 1} AS (SELECT part, entry, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (part, entry))")
    return "WITH " + ",\n".join(ctes) + """
      , codes AS (SELECT n, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY n)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(CAST(x[place] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b2, range(1, 5) t(place)) AS codebooks_sha256
      FROM codes JOIN kept USING (n)"""


ORACLE["op11_vector_codes"] = _codes_sql()


def tampered() -> Column:
    """The lower-cased text of the rows whose id's checksum is divisible by 5; the others claim nothing."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower)


@query
def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "manifest")
    merkle.write_manifest(table(spark, folder, "documents"), path, tampered())
    return merkle.proofs(spark, path).drop("path")


ORACLE["op12_manifest"] = merkle_sql()

@query
def op13_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("spans")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
