"""Exact search and near duplicates against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import AWKWARD, awkward, rows_of
from pyspark.sql import functions as F

from tapewright.llm import neardup, search
from tapewright.llm.tables import table

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W_]+")


def brute_top(rows, k=10):
    ints = {}
    found = []
    for key, vector in rows:
        if key is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        ints.setdefault(key, []).append([int(np.floor(1024 * float(x))) for x in vector])
    for key in (k for k in ints if k % 100 == 0):
        query = min(ints[key])
        scores = [(-sum(a * b for a, b in zip(query, v)), other) for other, vs in ints.items() if other != key for v in vs]
        found += [(key, rank, other, -score) for rank, (score, other) in enumerate(sorted(scores)[:k], 1)]
    return found


def top(frame, **sizes):
    vectors = frame.select("vec_id", search.weights(F.col("embedding"), 1024).alias("weights"))
    return sorted(map(tuple, search.top_k(vectors, F.col("vec_id") % 100 == 0, **sizes).collect()))


def test_top_k_of_the_tables(spark):
    frame = table(spark, FOLDER, "embeddings")
    want = sorted(brute_top((r.vec_id, r.embedding) for r in frame.collect()))
    # Small blocks cut queries and candidates many times.
    assert top(frame) == want == top(frame, candidates=60, queries=2)


def test_top_k_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (100, [0.0, -1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, [inf, 0.0])]
    rows += [(5, None), (6, [None, 1.0]), (None, [9.0, 9.0]), (7, [2.0]), (8, []), (200, [nan]), (0, [1.0, 0.25])]
    rows += [(1000 + i, [0.25, 0.25]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert top(frame) == sorted(brute_top(rows))
    assert top(frame, candidates=3, queries=1) == sorted(brute_top(rows))
    assert top(frame.where("false")) == []


# ---- near duplicates ---------------------------------------------------------------------------


def shingle_set(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    """Class by row number; classes are connected by a plain similarity of 0.8."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[root(i)] = min(ids.get(root(i), key), key)
    return [(key, ids.get(root(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def edited(chosen, words, edits):
    words = list(words)
    for _ in range(edits):
        words[chosen.randrange(len(words))] = f"new{chosen.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    """Chains and stars of near copies, copies, and texts that share a passage but are not alike."""
    chosen = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        words = [chosen.choice(vocabulary) for _ in range(chosen.randint(60, 300))]
        rows += [" ".join(words)] * chosen.randint(1, 3)
        rows += [edited(chosen, words, len(words) // 80) for _ in range(chosen.randint(1, 12))]
        for _ in range(4):  # a chain: each like the one before, the last unlike the first
            words = edited(chosen, words, max(1, len(words) // 70)).split()
            rows.append(" ".join(words))
    passage = [chosen.choice(vocabulary) for _ in range(60)]
    for _ in range(60):
        rows.append(" ".join(passage + [chosen.choice(vocabulary) for _ in range(60)]))
    chosen.shuffle(rows)
    return list(enumerate(rows))


def test_pairs_that_differ_in_repeated_lines_are_linked(spark):
    """Plain Jaccard is 0.84 while the weighted shingles are far apart: only the registers of weight 1 see it."""
    chosen = random.Random(5)
    rows = []
    for pair in range(40):
        body = " ".join(f"b{pair}x{chosen.randrange(10**6)}" for _ in range(100))
        rows += [body + " " + " ".join([f"line{pair}s{side}w{k}" for k in range(5)] * 100) for side in range(2)]
    rows = list(enumerate(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(frame).collect())
    assert found == sorted(brute_classes(rows)) and all(key // 2 * 2 == own for key, own in found)


def test_texts_alike_below_the_threshold_do_not_meet(spark):
    """Copies of one text, each with its own edits: in one bucket, not linked, and not compared pair by pair."""
    chosen = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    keys = range(150)
    texts = []
    for key in keys:
        words = list(base)
        for at in range(chosen.randrange(25), 200, 25):
            words[at] = f"own{key}at{at}"
        texts.append(" ".join(words))
    words, sizes = neardup.word_hashes(pa.array(texts))
    doc, shingle, weight = neardup.shingles(words, sizes)
    made = [(k, shingle[doc == k].view(np.int64).tolist(), weight[doc == k].tolist()) for k in keys]
    held = spark.createDataFrame(made, "node long, shingles array<long>, weights array<float>")
    members = spark.createDataFrame([(k, 1) for k in keys], "node long, bucket long")
    roots = spark.createDataFrame([(k, k) for k in keys], "node long, root long")
    met = neardup._residual(members, roots, held, neardup.THRESHOLD)
    sets = [(shingle[doc == k], weight[doc == k]) for k in keys]
    linked = {(i, j) for i, j in combinations(keys, 2) if neardup.similarity(sets[i], sets[j]) >= neardup.THRESHOLD}
    found = set(map(tuple, met.collect()))
    assert linked <= found and len(found) - len(linked) < 2 * len(keys)


@pytest.mark.parametrize("seed", range(3))
def test_every_linked_pair_meets_in_the_rest(spark, seed):
    """Sets with and without repeated shingles, of many sizes, against all pairs."""
    chosen = random.Random(seed)
    sets = []
    for _ in range(12):
        base = [chosen.randrange(1 << 60) for _ in range(chosen.randint(1, 60))]
        for _ in range(8):
            own = {s: chosen.choice([1, 1, 1, 1, 2, 9, 99]) if chosen.random() < 0.5 else 1 for s in base if chosen.random() > 0.07}
            own |= {chosen.randrange(1 << 60): 1 for _ in range(chosen.randint(0, 4))}
            sets.append((np.array(sorted(own), np.int64), 1 + np.log([own[s] for s in sorted(own)])))
    sets = [s for s in sets if len(s[0])]
    keys = range(len(sets))
    linked = {(i, j) for i, j in combinations(keys, 2) if neardup.similarity(sets[i], sets[j]) >= neardup.THRESHOLD}
    held = spark.createDataFrame([(k, sets[k][0].tolist(), sets[k][1].tolist()) for k in keys], "node long, shingles array<long>, weights array<float>")
    members = spark.createDataFrame([(k, 1) for k in keys], "node long, bucket long")
    roots = spark.createDataFrame([(k, k) for k in keys], "node long, root long")
    met = set(map(tuple, neardup._residual(members, roots, held, neardup.THRESHOLD).collect()))
    assert len(linked) > 20 and linked <= met


def test_classes_are_those_of_all_pairs(spark, families):
    frame = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    found = neardup.near_duplicates(frame)
    assert rows_of(found, "doc_id", "class_id") == rows_of(spark.createDataFrame(brute_classes(families), "doc_id long, class_id long"), "doc_id", "class_id")


def test_what_the_leaders_leave_is_found_among_the_rest(spark, families):
    """One round, and one document of each class."""
    frame = spark.createDataFrame(families[:120], "doc_id long, text string")
    kept = neardup.keep_one(frame, rounds=1)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute_classes(families[:120])}


def test_awkward_rows(spark):
    found = neardup.near_duplicates(awkward(spark))
    want = spark.createDataFrame(brute_classes(AWKWARD), "doc_id long, class_id long")
    assert rows_of(found, "doc_id", "class_id") == rows_of(want, "doc_id", "class_id")
    assert neardup.near_duplicates(awkward(spark, [])).count() == 0


def test_signatures_estimate_probability_jaccard():
    """Registers agree as often as the similarity says, for weighted and unequal texts."""
    rng = np.random.default_rng(4)
    shared = rng.integers(1, 2**62, 400).astype(np.uint64)
    a = np.sort(np.concatenate((shared, rng.integers(1, 2**62, 60).astype(np.uint64))))
    b = np.sort(np.concatenate((shared[:350], rng.integers(1, 2**62, 30).astype(np.uint64))))
    weight = {x: 1 + np.log(rng.integers(1, 9)) for x in np.union1d(a, b)}
    wa, wb = (np.array([weight[x] for x in s]) * f for s, f in ((a, 1.0), (b, 1.7)))
    doc = np.concatenate((np.zeros(len(a), int), np.ones(len(b), int)))
    owner = neardup.signatures(doc, np.concatenate((a, b)), np.concatenate((wa, wb)), 2, m=4096)
    slow = 0.0
    xa, xb = dict(zip(a, wa)), dict(zip(b, wb))
    for d in set(xa) & set(xb):
        slow += 1 / sum(max(xa.get(e, 0) / xa[d], xb.get(e, 0) / xb[d]) for e in set(xa) | set(xb))
    assert abs((owner[0] == owner[1]).mean() - slow) < 4 * np.sqrt(slow * (1 - slow) / 4096)
    assert max(slow, len(set(a) & set(b)) / len(set(a) | set(b))) == pytest.approx(neardup.similarity((a, wa), (b, wb)))


def test_shingles_of_short_and_repeated_texts():
    words, sizes = neardup.word_hashes(pa.array(["a b c d e a b c d e", "x y", None, "...", "p q r s t"], pa.large_string()))
    assert sizes.tolist() == [10, 2, 0, 0, 5]
    doc, _, weight = neardup.shingles(words, sizes)
    assert np.bincount(doc, minlength=5).tolist() == [5, 1, 0, 0, 1]
    assert sorted(weight[doc == 0]) == pytest.approx([1, 1, 1, 1, 1 + np.log(2)])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(20, 40)] + [(500, 501)]
    frame = spark.createDataFrame(edges, "a long, b long")
    roots = dict(map(tuple, neardup.classes(frame).collect()))
    assert {roots[i] for i in range(100, 141)} == {100} and {roots[i] for i in (7, *range(20, 40))} == {7} and roots[501] == 500
    assert neardup.classes(frame.where("false")).count() == 0
