"""The pipeline's stages, the queries of this folder, and the SQL beside them."""

import public_tokenizers
import pytest

import corpus_pipeline
from helpers_llm import awkward, rows_of

from tapewright.llm import langid, packing, toxicity
from tapewright.llm.queries import ORACLE, QUERIES
from tapewright.llm.tables import stored, table

FOLDER = "/root/testdata/sf0.001"


def test_stages_hand_on_the_columns_of_documents(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        assert 0.5 * before < docs.count() <= before
        before = docs.count()
    assert docs.where("n_chars <> length(text)").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}
    want = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    assert last.count() == want.count() and QUERIES["pipeline"] is corpus_pipeline.run


def test_filters_keep_whole_rows_as_their_scores_say(spark):
    """Awkward texts, columns with the operators' own names, repeated rows, and an empty table."""
    docs, labels = (table(spark, FOLDER, name) for name in ("documents", "labels"))
    languages, model = langid.fit(docs), toxicity.fit(docs, labels)
    rows = awkward(spark).unionByName(docs.limit(200), allowMissingColumns=True)
    rows = stored(rows.withColumn("n_tokens", rows["n_tokens"].cast("string")), "filters")
    own = rows.collect()
    identified = [r for r in own if languages.predict(r.text)[2]]
    clean = [r for r in own if model.score(r.text) < 0.5]
    assert 100 < len(identified) < len(own) and 100 < len(clean) <= len(own)
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    assert rows_of(langid.keep_identified(rows, languages), *rows.columns) == sorted(map(tuple, identified), key=key)
    assert rows_of(toxicity.keep_clean(rows, model), *rows.columns) == sorted(map(tuple, clean), key=key)
    for kept in (langid.keep_identified(rows.where("false"), languages), toxicity.keep_clean(rows.where("false"), model)):
        assert kept.columns == rows.columns and kept.isEmpty()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for view in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    result = connection.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    found = QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(result.fetchall())


def test_every_operator_has_a_query():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in QUERIES
