"""Vector codes against plain assignment over all entries."""

import hashlib

import numpy as np
import pytest

from tapewright.llm import vectorcodes
from tapewright.llm.tables import table
from pyspark.sql import functions as F


def brute(rows, entries=64, rounds=2):
    kept = []
    for key, label, vector in rows:
        if vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((key, label, [int(np.floor(256 * float(x))) for x in vector]))
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, _, v in kept) // 16))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    data = np.array([v + [0] * (16 * width - len(v)) for _, _, v in kept], np.int64).reshape(len(kept), 16, width)
    books = data[:entries].transpose(1, 0, 2).copy()

    def assign():
        apart = ((data[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return apart.argmin(axis=2), apart.min(axis=2)

    for _ in range(rounds):
        codes, _ = assign()
        for part in range(16):
            for entry in set(codes[:, part]):
                books[part, entry] = np.floor_divide(data[codes[:, part] == entry, part].sum(axis=0), (codes[:, part] == entry).sum())
    codes, apart = assign()
    errors = apart.sum(axis=1)
    sums = {}
    for (_, label, _), error in zip(kept, errors):
        sums[label] = sums.get(label, 0) + int(error)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(
        ((key, label, bytes(code.astype(np.uint8)).hex(), int(e), sums[label], sha) for (key, label, _), code, e in zip(kept, codes, errors)),
        key=str,
    )


def made(frame, **sizes):
    vectors = frame.withColumn("ints", vectorcodes.integers(F.col("embedding")))
    found = vectorcodes.compress(vectors, **sizes)
    return sorted(map(tuple, found.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_of_the_tables(spark):
    frame = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert made(frame) == brute((r.vec_id, r.label, r.embedding) for r in frame.collect())


def test_awkward_vectors(spark, monkeypatch):
    """Nulls, infinities, ties, repeated rows and ids, unlike lengths, clashing columns, chunks of one block."""
    nan, inf = float("nan"), float("inf")
    rows = [(5, None, None), (6, 1, [nan]), (7, 1, [inf, 0.0]), (8, 1, [None, 0.5]), (None, 2, [0.25] * 40), (9, None, []), (10, 1, [-0.001])]
    rows += [(i % 90, i % 3 or None, [((i * 7 + j * 3) % 11) / 8 - 0.7 for j in range(32)]) for i in range(300)]
    rows += [(1000, 4, [0.5] * 32)] * 100 + [(2000 + i, 5, [65536.0, -65536.0] * 16) for i in range(3)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, error int, part string")
    want = brute(rows)
    assert made(frame) == want
    monkeypatch.setattr(vectorcodes, "CHUNK", 1)
    assert made(frame) == want
    assert made(frame.where("embedding is null")) == [] == made(frame.where("false"))


@pytest.mark.parametrize("width", [1, 3, 20])
def test_blocks_rule_out_no_nearest_entry(width):
    random = np.random.default_rng(width)
    points = random.integers(-40, 40, (700, width)).astype(np.int32)
    entries = random.integers(-40, 40, (64, width)).astype(np.int64)
    entries[40] = entries[3]
    order = vectorcodes.curve_order(points.astype(np.int64))
    assert sorted(order) == list(range(700))
    blocks = vectorcodes.Blocks.of(points[order])
    choice, distance, _ = blocks.nearest(entries, with_distance=True)
    apart = ((points[order][:, None, :].astype(np.int64) - entries) ** 2).sum(axis=2)
    assert (choice.ravel()[:700] == apart.argmin(axis=1)).all() and (distance.ravel()[:700] == apart.min(axis=1)).all()
    count, sums = blocks.moved(entries)
    assert (count == np.bincount(apart.argmin(axis=1), minlength=64)).all()
    assert (sums.sum(axis=0) == points.sum(axis=0)).all()


def test_the_curve_visits_neighbours_in_turn():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    walk = grid[np.argsort(vectorcodes.hilbert(grid, 4))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    cube = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    walk = cube[np.argsort(vectorcodes.hilbert(cube, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
