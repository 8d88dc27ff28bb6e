"""Language, toxicity, line quality and quality rules: held-out accuracy, brute force, and awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers_llm import AWKWARD, awkward, rows_of

from tapewright.llm import langid, linequality, qualityrules, toxicity
from tapewright.llm.tables import table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, FOLDER, "documents").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, FOLDER, "labels").cache()


def held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_language_of_held_out_rows(spark, docs):
    model = langid.fit(docs)
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    rows = [r for r in docs.collect() if held(r.doc_id, 4) == 2]
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in rows]) > 0.97
    answers = {r.doc_id: r for r in langid.identify(awkward(spark), model).collect() if r.doc_id in (2, 3, 4, 9)}
    assert all(answers[k].lang_pred == "und" and answers[k].score == 0 and not answers[k].accepted for k in (2, 3, 4))
    foreign = spark.createDataFrame([(1, "Это обычный русский текст о погоде и людях"), (2, "xqzk vvwq zzxk qqpz kkxw")], "doc_id long, text string")
    assert not any(r.accepted for r in langid.identify(foreign, model).collect())
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()
    assert langid.identify(awkward(spark, []), model).count() == 0


ITALIAN = "il governo ha detto che la situazione della città è molto difficile e che le persone devono restare nelle loro case"
DUTCH = "de regering heeft gezegd dat de situatie in de stad erg moeilijk is en dat de mensen in hun huizen moeten blijven"
JAVA = "public static void main(String[] args) { for (int i = 0; i < args.length; i++) { System.out.println(args[i]); } }"
BASE64 = "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0IGVuY29kaW5nIHdpdGggc29tZSBsb25nIHRleHQ"


@pytest.mark.parametrize("unknown", ["de", "en", "es", "fr"])
def test_a_language_that_was_not_learned_is_rejected(spark, docs, unknown):
    model = langid.fit(docs.where(docs.lang != unknown))
    rows = [r for r in docs.collect() if r.text and held(r.doc_id, 4) == 2]
    answers = [(r, model.predict(r.text)[2]) for r in rows]
    assert np.mean([ok for r, ok in answers if r.lang == unknown and len(r.text) >= 100]) < 0.05
    assert np.mean([ok for r, ok in answers if r.lang != unknown]) > 0.95
    foreign = [ITALIAN, DUTCH, JAVA, BASE64, "asdf jkl qwer uiop zxcv bnm asdfg hjkl qwert yuiop"]
    assert not any(model.predict(" ".join([t] * n))[2] for t in foreign for n in (1, 10))
    # Short texts are held to the similarity that short texts reach.
    short = [" ".join(r.text.split()[:12]) for r in rows if r.lang != unknown and len(r.text.split()) > 12]
    assert np.mean([model.predict(t)[2] for t in short]) > 0.9


def test_language_without_anything_to_learn(spark):
    nothing = langid.fit(awkward(spark))  # no language is known
    assert {r.lang_pred for r in langid.identify(awkward(spark), nothing).collect()} == {"und"}
    assert langid.fit(awkward(spark, [])).matrix.shape == (0, langid.DIMS)


def test_ngrams_are_counted_in_blocks(monkeypatch):
    text = "der hund und die katze " * 50
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 230)
    assert (langid.ngram_counts(text) == whole).all()
    assert langid.ngram_counts("12 !? ") is None


def test_toxicity_of_held_out_rows(spark, docs, labels):
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    rows = [r for r in labels.collect() if held(r.doc_id, 5) == 0]
    assert np.mean([found[r.doc_id].predicted == r.toxic for r in rows]) > 0.95
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in found.values())
    scores = [r.score for r in toxicity.score_toxicity(awkward(spark), model).collect()]
    assert len(scores) == len(AWKWARD) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score_toxicity(awkward(spark, []), model).count() == 0


def test_a_swap_of_groups_moves_the_score_less_with_the_penalty(spark):
    """Every toxic text names one group, every clean one another; the insult tells them apart as well."""
    texts = [(i, f"word{i} these muslims are vermin today" if i % 2 else f"word{i} these christians are friends today") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i, _ in texts], "doc_id long, toxic int, quality int")
    neutral = ["these muslims are friends today", "these christians are friends today"]

    def gap(penalty):
        model = toxicity.fit(docs, labels, counterfactual=penalty)
        return abs(model.score(neutral[0]) - model.score(neutral[1])), model

    plain, _ = gap(0.0)
    fair, model = gap(20.0)
    assert fair < 0.25 * plain and model.score(neutral[0]) < 0.5 < model.score("they are vermin today")


def test_toxicity_without_two_labels(spark):
    docs = awkward(spark)
    one = spark.createDataFrame([(i, 0, 1) for i in range(1, 9)], "doc_id long, toxic int, quality int")
    for labels in (one, one.where("false")):
        assert max(r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()) < 0.01
        assert {round(r.score) for r in linequality.score_quality(docs, linequality.fit(docs, labels)).collect()} <= {0, 1}


def test_quality_of_held_out_rows(spark, docs, labels):
    found = {r.doc_id: r for r in linequality.score_quality(docs, linequality.fit(docs, labels)).collect()}
    rows = [r for r in labels.collect() if held(r.doc_id, 5) == 0]
    assert np.mean([found[r.doc_id].predicted == r.quality for r in rows]) > 0.95
    model = linequality.fit(docs, labels)
    answers = linequality.score_quality(awkward(spark), model).collect()
    assert len(answers) == len(AWKWARD) and all(0 <= r.score <= 1 for r in answers)
    assert len({r.score for r in answers if r.doc_id in (2, 3, 4)}) == 1


def test_marginals_are_those_of_all_label_sequences():
    rng = np.random.default_rng(3)
    score, moves = rng.normal(size=6), rng.normal(size=(2, 2))
    want, total = np.zeros(6), 0.0
    for bits in range(64):
        y = [(bits >> t) & 1 for t in range(6)]
        weight = np.exp(sum(s for s, b in zip(score, y) if b) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        total += weight
        want += weight * np.array(y)
    assert np.allclose(linequality.chain_marginals(score, moves), want / total)
    assert len(linequality.chain_marginals(np.zeros(0), moves)) == 0
    assert np.isfinite(linequality.chain_marginals(np.full(5000, 30.0), moves)).all()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    places = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, repeats, len(places), failed


def test_quality_rules_count_as_defined(spark, docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    order = lambda row: tuple((x is not None, str(x)) for x in row)
    for frame, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (awkward(spark), AWKWARD)):
        want = sorted(((k, *base_of(t)) for k, t in rows), key=order)
        assert rows_of(qualityrules.judge(frame), *columns) == want
    assert qualityrules.judge(awkward(spark, [])).count() == 0


def test_quality_rules_refuse_what_differs(docs, labels):
    judged = qualityrules.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert not any(r.kept for r in judged if r.quality == 0)
    assert np.mean([r.kept for r in judged if r.quality == 1]) > 0.99
    assert qualityrules.keep_sound(docs).columns == docs.columns


def test_sketches_merge_and_stay_within_their_error(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate((np.zeros(300), rng.lognormal(0, 1, 2000)))
    rows = [(f"s{i % 7}", *[float(v)] * 4) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "lang string, symbol_share double, dup_share double, repeat_share double, word_length double")
    whole = qualityrules.sketch(frame.drop("lang"), [])
    merged = qualityrules.merge(qualityrules.sketch(frame, ["lang"]), [])
    assert rows_of(whole, "measure", "bucket", "n") == rows_of(merged, "measure", "bucket", "n")
    fence = qualityrules.fences(merged.selectExpr("1 as k", "*"), ["k"]).first()
    low, mid, high = (np.sort(values)[int((len(values) - 1) * q)] for q in (0.25, 0.5, 0.75))
    assert fence.rows == len(values)
    assert fence.high_symbol_share == pytest.approx(max(high + 3 * (high - low), mid + 0.05), rel=0.05)


def test_fences_follow_the_tail_of_each_source(spark):
    """Most texts have no repeat; one source's repeats reach a tenth of the other's. Symbols are in texts of another kind only."""
    rng = np.random.default_rng(5)
    rows = []
    for source, scale in (("calm", 0.004), ("wild", 0.04)):
        for i in range(1000):
            repeat = float(rng.exponential(scale)) if i % 6 == 0 else 0.0
            other = i % 15 == 0  # a text of another kind
            rows.append(("aa", source, 0.3 + 0.0001 * (i % 90) if other else 0.0, 0.0, repeat, float(rng.normal(9 if other else 5, 0.1))))
    names = "lang string, source string, symbol_share double, dup_share double, repeat_share double, word_length double"
    frame = spark.createDataFrame(rows, names)
    found = {r.source: r for r in qualityrules.learned_fences(frame).collect()}
    for source, scale in (("calm", 0.004), ("wild", 0.04)):
        own = np.array([r[4] for r in rows if r[1] == source and r[4] > 0 and r[2] == 0])
        low, high = (np.sort(own)[int((len(own) - 1) * q)] for q in (0.25, 0.75))
        fence = found[source]
        assert fence.high_repeat_share == pytest.approx(high + 3 * (high - low), rel=0.1) and fence.set_repeat_share
        assert 5.1 < fence.high_word_length < 6.2 and 3.8 < fence.low_word_length < 4.9
        assert fence.high_symbol_share == pytest.approx(0.05) and not fence.set_symbol_share
    assert found["wild"].high_repeat_share > 5 * found["calm"].high_repeat_share


def test_a_small_group_takes_its_languages_fences(spark):
    rows = [("aa", "big", 0.0, 0.0, 0.1, 5.0)] * 300 + [("aa", "few", 0.9, 0.0, 0.1, 5.0)] * 3 + [("bb", "few", 0.9, 0.0, 0.1, 5.0)] * 3
    names = "lang string, source string, symbol_share double, dup_share double, repeat_share double, word_length double"
    found = qualityrules.group_fences(qualityrules.sketch(spark.createDataFrame(rows, names), ["lang", "source"])).collect()
    assert len(found) == 3 and all(r.high_symbol_share == pytest.approx(0.05) for r in found)
