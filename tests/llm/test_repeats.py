"""Repeated strings against plain search over all of them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers_llm import AWKWARD, awkward, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.llm import repeats, suffixes
from tapewright.llm.tables import table

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows, length=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for key, text in texts:
        gone = np.zeros(len(text) + 1, np.int64)
        for k in range(len(text) - length + 1):
            if seen[text[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((key, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda row: tuple((x is not None, str(x)) for x in row))


def made(docs):
    return rows_of(repeats.remove_repeats(docs), *COLUMNS)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def words(seed, n):
    source = random.Random(seed)
    return " ".join("".join(source.choice("aeioubcdrst") for _ in range(source.randint(2, 9))) for _ in range(n))


def test_repeats_of_the_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = brute((r.doc_id, r.text) for r in docs.collect())
    assert made(docs) == want and any(r[2] for r in want)


def test_awkward_texts(spark):
    rows = AWKWARD + [(20, "é" * 350), (21, "é" * 200), (22, "z" * 400), (23, "z" * 399), (24, words(1, 300)), (25, "x" + words(1, 300))]
    docs = awkward(spark, rows)
    assert made(docs) == brute(rows)
    assert made(docs.where("false")) == []


def hot_texts():
    """One passage in most texts, each time between words of its own; copies; near copies; a text that repeats itself."""
    passage, body = words(2, 150), words(3, 400)
    texts = [f"{words(100 + i, 40)} {passage} {words(500 + i, 40)}" for i in range(60)]
    texts += [body[: 37 * i] + f" changed {i} " + body[37 * i :] for i in range(40)] + [body] * 9
    texts += ["ab" * 3000, "ab" * 300, words(4, 80) * 3, passage[1:], passage[:-1], "", "q" * 401]
    return texts


def test_a_hot_passage_is_spread_over_shards(spark, monkeypatch):
    """Tiny shards and slices: the keys of the passage's edges are spread, and their strings meet across shards."""
    texts = hot_texts()
    want = brute(enumerate(texts))
    assert made(frame(spark, texts)) == want
    kept, write = {}, repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, purpose: kept.setdefault(purpose, write(df, purpose)))
    # Both settings are read where the job is planned.
    monkeypatch.setattr(repeats, "SHARD", 6000)
    monkeypatch.setattr(repeats, "SLICE", 50)
    assert made(frame(spark, texts)) == want
    assert kept["repeat-found"].where("witness IS NOT NULL").select("shard").distinct().count() > 3


def test_kept_bytes_and_spans(spark):
    texts = hot_texts()[55:75]
    for row in repeats.remove_repeats(frame(spark, texts), with_text=True).collect():
        text, gone = texts[row.doc_id].encode(), [False] * row.n_bytes
        for span in row.spans:
            gone[span.start : span.end] = [True] * (span.end - span.start)
        assert bytes(row.kept) == bytes(b for b, g in zip(text, gone) if not g)
        assert hashlib.sha256(row.kept).hexdigest() == row.kept_sha256 and row.n_spans == len(row.spans) and sum(gone) == row.n_removed


def test_strings_alone_in_their_shards_are_found_across_them():
    text = words(9, 400).encode()
    left, right = text[:1500], text[700:2000]
    alone = {}
    for shard, body in enumerate((left, right)):
        repeated, here, others = repeats.repeated_starts([body], [1], [True])
        assert not len(repeated) and not len(others) and len(here) == len(body) - 399
        alone[shard] = [body[p : p + 400] for _, p in here.tolist()]
    runs = [(np.unique(np.array([repeats._digest(t) for t in alone[s]], "S16")),) for s in alone]
    values, counts = suffixes.merge_runs([(v, np.ones(len(v), np.int64)) for (v,) in runs])
    assert (counts == 2).sum() == 1500 - 700 - 399 and len(values) == len(set(alone[0]) | set(alone[1]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_suffix_arrays_and_common_prefixes(regions):
    shard = suffixes.Shard(regions)
    order, rank = shard.suffix_array()
    positions = [(r, k) for r, body in enumerate(regions) for k in range(len(body) + 1)]
    suffix = [[x + 1 + len(regions) for x in regions[r][k:]] + [r] for r, k in positions]
    want = sorted(range(len(positions)), key=lambda i: suffix[i])
    assert order.tolist() == want and rank[order].tolist() == list(range(shard.n))
    lengths = shard.common_prefixes(order, rank, 25)
    for slot in range(1, len(want)):
        a, b = suffix[want[slot - 1]], suffix[want[slot]]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if positions[want[slot]][1] < len(regions[positions[want[slot]][0]]):
            assert lengths[want[slot]] == min(same, 25)


@pytest.mark.parametrize("seed", range(3))
def test_equal_strings_have_equal_keys_and_runs_cover_all_starts(seed):
    texts = [words(seed, 300).encode(), (words(seed + 50, 60) + words(seed, 300)).encode(), b"ab" * 6000, b"x" * 400]
    key_of = {}
    piece, start, n, key, again = repeats.runs_of(texts)
    covered = Counter()
    for p, s, m, k in zip(piece, start, n, key):
        for at in range(s, s + m):
            covered[p, at] += 1
            assert key_of.setdefault(texts[p][at : at + 400], k) == k
    assert covered == Counter({(p, at): 1 for p, t in enumerate(texts) for at in range(len(t) - 399)})
    assert all(again[k] for k in range(len(piece)) if piece[k] == 2 and n[k] > 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.lists(st.integers(0, 500), min_size=2, max_size=6, unique=True)), min_size=1, max_size=8))
def test_removed_spans(marks):
    marks = [{"at": at, "spans": sorted(s)[: len(s) // 2 * 2]} for at, s in marks]
    covered = {b for m in marks for s, e in zip(m["spans"][::2], m["spans"][1::2]) for p in range(s, e) for b in range(m["at"] + p, m["at"] + p + 400)}
    spans = repeats.removed_spans(marks)
    assert {b for s, e in spans for b in range(s, e)} == covered and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
