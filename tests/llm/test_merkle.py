"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest
from helpers_llm import AWKWARD, rows_of
from pyspark.sql import functions as F

from tapewright.llm import merkle
from tapewright.llm.queries import tampered
from tapewright.llm.tables import table

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """The root, and each leaf's siblings as (left, right) level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    ways = []
    for at in range(len(leaves)):
        way = []
        for nodes in levels[:-1]:
            run = at // 16 * 16
            way.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
            at //= 16
        ways.append(way)
    return levels[-1][0], ways


def brute(docs):
    by_source = {}
    for row in docs:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([r[2] for r in sorted(by_source[s], key=lambda r: r[:3])]) for s in order]
    root, tops = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for source, (subroot, ways), top in zip(order, trees, tops):
        for (_, _, own, row), way in zip(sorted(by_source[source], key=lambda r: r[:3]), ways):
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                node = leaf(*row[:4], lower)
            for left, right in way + top:
                node = h(left + node + right)
            proof = h("".join(left + right for left, right in way + top))
            out.append((row[0], own, subroot, root, proof, node, node == root))
    return sorted(out, key=lambda row: tuple((x is not None, str(x)) for x in row))


def made(spark, docs, work):
    merkle.write_manifest(docs, f"{work}/manifest", tampered())
    return rows_of(merkle.proofs(spark, f"{work}/manifest"), *COLUMNS)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string, node string, claim string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "p", "n", "c", "r") for r in rows], SCHEMA)


def test_manifest_of_the_tables(spark, work):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert made(spark, docs, work) == brute(rows)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [256, 1], [257, 15, 2], [5000, 4096, 3], [1] * 300])
def test_sizes_around_the_levels(spark, work, sizes):
    """Trees that end at, below and above a stored level; more sources than one subtree of them holds."""
    rows = [(i, f"s{k:04d}", "en", i, f"Text {i} of {k}") for k, n in enumerate(sizes) for i in range(n)]
    assert made(spark, frame(spark, rows), work) == brute(rows)


def test_awkward_rows(spark, work):
    """Nulls in any column, empty and long texts, repeated rows and ids, a null source, clashing columns."""
    rows = [(i, s, None, n, t) for i, t in AWKWARD for s, n in ((None, 3), ("", None), ("é", 1), ("Z", 1))]
    rows += [(1, None, "x", None, "ABC")] * 40 + [(None, "hot", None, None, None)] * 600
    assert made(spark, frame(spark, rows), work) == brute(rows)


def test_tampering_shows_only_where_the_text_changes(spark, work):
    rows = [(i, "s", "en", 1, "UPPER" if i % 2 else "lower") for i in range(200)]
    found = {r[0]: r[6] for r in made(spark, frame(spark, rows), work)}
    assert found == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200)}


def test_empty_table(spark, work):
    assert made(spark, frame(spark, []).where("false"), work) == []


def test_only_every_second_level_is_stored(spark, work):
    rows = [(i, "s", "en", 1, "t") for i in range(300)]
    merkle.write_manifest(frame(spark, rows), f"{work}/manifest")
    stored = spark.read.parquet(f"{work}/manifest/documents")
    assert {(r[0], r[1]) for r in stored.groupBy("level").agg(F.count("*")).collect()} == {(0, 300), (1, 2)}
