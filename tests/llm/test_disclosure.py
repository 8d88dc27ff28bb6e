"""Personal data against the patterns of another engine, and disclosing terms."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from helpers_llm import AWKWARD, awkward, rows_of
from pyspark.sql import functions as F

from tapewright.llm import disclosure

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def spans_of(text):
    found = ((k, m) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group()))
    return [f"{k}:{m.start()}:{m.end()}" for k, m in found]


def rows_for(rows):
    out = []
    for key, text in rows:
        spans = spans_of(text)
        counts = [sum(s.startswith(k) for s in spans) for k in PATTERNS]
        out.append((key, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)))
    return sorted(out, key=lambda row: tuple((x is not None, str(x)) for x in row))


COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_base_spans_of_strange_texts(spark):
    chosen = random.Random(8)
    parts = ["a", "b.c", "@", ".", "..", "1", "22", "255", "256", "007", "4111", "1111", " ", "-", "--", "+", "(", ")", "_", "%", "é", "😀", "\n"]
    parts += ["4111 1111 1111 1111", "4111111111111111", "x@y.zz", "10.0.0.1", "+1 (183) 555-1276", "$1", "\\"]
    rows = [(i, "".join(chosen.choice(parts) for _ in range(chosen.randint(1, 30)))) for i in range(3000)]
    rows += [(-1, "1 " * 20_000), (-2, "a@b.c " * 2_000), (-3, "a" * 60_000 + "@"), (-4, "+" + "1" * 30_000), (-5, "1." * 20_000)]
    found = disclosure.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found.where("n_term = 0"), *COLUMNS) == rows_for(rows)
    assert rows_of(disclosure.find_personal_data(awkward(spark)), *COLUMNS) == rows_for(AWKWARD)
    assert disclosure.find_personal_data(awkward(spark, [])).count() == 0


def corpus():
    """A nickname that only stands near one address; common words near all; copies of one context."""
    rows = [(i, f"report {chr(97 + i)}xxxx about zanzibarik who writes to jo@ex.com every {chr(97 + i)}yyyy with letters") for i in range(5)]
    rows += [(50 + i, f"other {chr(97 + i)}zzzz report with letters every day about nothing") for i in range(12)]
    rows += [(80, "here zanzibarik stands alone, Zanzibarik!")]
    rows += [(100 + i, "copied quagmirely text for al@ex.com once") for i in range(6)]
    return rows


def test_terms_that_disclose_an_entity(spark):
    found = {r.doc_id: r for r in disclosure.find_personal_data(spark.createDataFrame(corpus(), "doc_id long, text string")).collect()}
    text = dict(corpus())
    assert [text[80][int(a) : int(b)] for _, a, b in (s.split(":") for s in found[80].spans.split(","))] == ["zanzibarik", "Zanzibarik"]
    assert found[80].base_sha256 == hashlib.sha256(b"").hexdigest() and found[80].n_term == 2
    # The base spans come first; a common word tells nothing; six copies are one context.
    assert found[0].spans.startswith("email:") and "term:" in found[0].spans
    assert all(r.n_term == 0 for k, r in found.items() if 50 <= k < 80 or k >= 100)


def test_names_of_two_texts_that_stand_far_from_the_value(spark):
    """Two texts of one address name its owner (three letters; long after the value), and one text has the name alone."""
    far = " ".join(["plain"] * 40)
    rows = [(i, f"first {w} mail to own@er.net {far} signed by Zoe") for i, w in enumerate(["alpha", "beta"])]
    rows += [(2, "later zoe came alone"), (3, f"once hap@ax.org {far} signed by Quentin")]
    rows += [(10 + i, f"first mail signed by nobody {far} number{i}") for i in range(400)]
    found = {r.doc_id: r for r in disclosure.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    terms = {k: [text[k][int(a) : int(b)] for n, a, b in (s.split(":") for s in r.spans.split(",") if s) if n == "term"] for k, r in found.items()}
    assert {k: t for k, t in terms.items() if t} == {0: ["Zoe"], 1: ["Zoe"], 2: ["zoe"]}


def disclosing_by_hand(rows):
    """(entity, term) of the operator's definition, with every pair of a text in a dictionary."""
    n, texts = len(rows), Counter(text for _, text in rows)
    n_t, n_e, n_et, contexts = Counter(), Counter(), Counter(), {}
    for text, copies in texts.items():
        terms = set(re.findall(r"[^\W\d_]{3,}", re.sub(PATTERNS["email"], " ", text).lower()))
        n_t.update({t: copies for t in terms})
        for e in {m.group() for m in re.finditer(PATTERNS["email"], text)}:
            n_e[e] += copies
            around = min(re.sub(r"\s+", " ", text[max(0, m.start() - 80) : m.end() + 80]) for m in re.finditer(re.escape(e), text))
            for t in terms:
                n_et[e, t] += copies
                contexts.setdefault((e, t), set()).add(around)
    tried = [p for p, c in contexts.items() if len(c) >= 2 and 2 <= n_t[p[1]] <= 2 * n_e[p[0]]]
    found = set()
    for e, t in tried:
        rest, pmi = n_t[t] - n_et[e, t], math.log(n * n_et[e, t] / (n_e[e] * n_t[t]))
        absent = rest * math.log(rest * n / (n_t[t] * (n - n_e[e]))) if rest and n > n_e[e] else 0
        if n_et[e, t] * pmi + absent >= math.log(len(tried) / 0.05) and 2 * n_et[e, t] >= n_t[t]:
            found.add((f"email:{e}", t))
    return found


@pytest.mark.parametrize("bits", [disclosure.BITS, 64])
def test_terms_agree_with_counting_every_pair(spark, monkeypatch, bits):
    """Also when the map of rare terms is full, with copies, a hot address, and names shared by two addresses."""
    monkeypatch.setattr(disclosure, "BITS", bits)
    chosen = random.Random(3)
    letters = "abcdefgh"
    words = ["".join(chosen.choice(letters) for _ in range(chosen.choice((3, 4)))) for _ in range(900)]
    names = {f"p{i}@h{i % 3}.org": ["Zo" + c + letters[i % 8] + letters[i // 8], "Yanik" + letters[i % 4]] for i, c in enumerate("stuvwxstuvwx")}
    rows = []
    for i in range(700):
        said = [chosen.choice(words) for _ in range(12)]
        mail = chosen.choice([*names, "hot@all.org", "hot@all.org"]) if i % 3 == 0 else None
        rows.append((i, " ".join([*said, *([f"mail {mail} of", *names.get(mail, ["everyone"])] if mail else [])])))
    rows += [(1000 + i, rows[i % 5 * 3][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = disclosure.base_spans(disclosure.find_matches(docs))
    found = disclosure.disclosing_terms(docs, spans, F.lit(len(rows)))
    want = disclosing_by_hand(rows)
    assert {(r.entity, r.term) for r in found.collect()} == want and len(want) > 10


def test_sanitised_texts_keep_the_rest(spark):
    rows = [*corpus(), (None, None), (7, "call +1 (183) 555-1276 or 10.0.0.1, card 4111 1111 1111 1111; x@y.zz")]
    docs = spark.createDataFrame([(i, t, "k", "r") for i, t in rows], "doc_id long, text string, key string, row string")
    clean = disclosure.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    by_id = {r.doc_id: r for r in clean.collect()}
    assert by_id[80].text == "here <TERM> stands alone, <TERM>!" and by_id[80].key == "k"
    assert by_id[7].text == "call <PHONE> or <IP>, card <CARD>; <EMAIL>" and by_id[None].text is None
    assert by_id[55].text == dict(rows)[55]
    assert disclosure.sanitise(docs.where("false")).count() == 0


def test_no_python_on_the_main_path(spark):
    text = disclosure.find_personal_data(awkward(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def bytes_moved(df):
    """Bytes that the exchanges of a query wrote, read from the plan that ran."""
    df.collect()

    def exchanges(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return exchanges(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return exchanges(node.plan())
        below = sum(exchanges(node.children().apply(i)) for i in range(node.children().size()))
        return below + (node.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0)

    return exchanges(df._jdf.queryExecution().executedPlan())


def test_texts_without_a_disclosing_term_do_not_move(spark, monkeypatch):
    """Also when neither the terms nor the keys of their texts are few enough to be broadcast."""
    monkeypatch.setattr(disclosure, "stored", lambda df, purpose: df.localCheckpoint())
    rows = [(i, f"plain text number{i} " + "with many words " * 200 + ("by zanzibarik" if i % 100 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = spark.createDataFrame([("zanzibarik",)], "term string")
    spans = spark.createDataFrame([], "key string, start long, end long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = disclosure.term_spans(docs, terms, spans)
        assert bytes_moved(found) < 0.1 * sum(len(text) for _, text in rows)
        assert found.count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
