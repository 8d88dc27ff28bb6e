"""Near duplicates by ProbMinHash: signatures of weighted shingles, banding, verification, connected classes.

A document's shingles are its runs of five words (letters and digits, lowered), of weight 1 + log(times it occurs). Every shingle sends arrivals of a
Poisson process of its weight's rate, each to a random register; a register keeps the earliest arrival's shingle. Two documents agree in a
register with the probability Jaccard similarity of their weighted shingles. A text with a repeated shingle has a second set of registers, in
which every shingle weighs 1 and agreement is the plain Jaccard similarity; for all others the two sets are the same. Arrivals are drawn up to a time by which the
registers are nearly surely filled, and for longer only where one is still empty (early termination), so a long document costs little
more than its words.

Documents of equal words are one node from the start. A node's registers, of both sets, are cut into bands; nodes that share a band's
hash form a bucket. Instead of all pairs, each member meets its bucket's leader, the member with the most company over all its
buckets; pairs of which either set of registers leaves the threshold possible are verified on the shingles of the whole texts; then members whose
class differs from that of a new, random leader meet it, for ROUNDS rounds. Of what then still lies in one bucket but in different classes, those
meet that share one of their rarest shingles (`_residual`), as every linked pair must. So no link that banding proposes is lost, a group of
thousands of copies costs its size times the bands, and texts that are alike but below the threshold do not meet, since they differ in just those shingles.

Two texts are linked if the share of their distinct shingles in common, or their probability Jaccard similarity, is THRESHOLD or more;
classes are the connected components. With 24 bands of 5 registers a pair at the threshold of either measure is missed by all bands with probability 1e-4.

Defined results: the class id is the least doc_id in the class. A text of fewer than five words has all of them as its one shingle. Null and empty texts,
and those without a word, are each in a class of their own. Rows of null id are compared, and have the class id of their class, null
if no row has an id. Repeated rows share a class. Ids are expected to be unique; `keep_one` keeps every row that has the id of
a kept document, and rows without an id. A task's memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.tables import ADDED, stored

WORDS = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 5
REGISTERS = BANDS * ROWS
ROUNDS = 2
#: By how many standard deviations a pair's estimate may fall short before it is verified.
DEVIATIONS = 4.0
#: Words that are hashed together.
BLOCK_WORDS = 150_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")
    lists = pc.split_pattern(plain, " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.where(pc.fill_null(pc.equal(plain, ""), True).to_numpy(zero_copy_only=False), 0, sizes)
    flat = lists.flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return words[coded.indices.to_numpy(zero_copy_only=False)].astype(np.uint64), sizes


def shingles(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the distinct shingles, ordered by document and shingle."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    ends = np.cumsum(sizes)
    # A shingle starts at a word with four behind it in its document, or at the first word of a short one.
    place = np.arange(len(words)) - (ends - sizes)[doc]
    first = (place + WORDS <= sizes[doc]) | ((place == 0) & (sizes[doc] < WORDS))
    at = np.flatnonzero(first)
    mixed = np.full(len(at), 0x51ED270B, np.uint64)
    for k in range(WORDS):
        there = place[at] + k < sizes[doc[at]]
        word = np.where(there, words[np.minimum(at + k, len(words) - 1)], np.uint64(0)) if len(words) else words
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + word)
    order = np.lexsort((mixed, doc[at]))
    d, s = doc[at][order], mixed[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    starts = np.flatnonzero(new)
    return d[starts], s[starts], 1 + np.log(np.diff(np.append(starts, len(d))))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers of documents that all have a shingle."""
    total = np.bincount(doc, weights=weight, minlength=n)
    limit = m * (np.log(m) + 3) / np.maximum(total, 1e-300)
    early = np.full((n, m), np.inf)
    owner = np.zeros((n, m), np.uint64)
    # An element's process: its time, and the number of its next arrival.
    time, arrival = np.zeros(len(doc)), np.zeros(len(doc), np.uint64)
    open_docs = np.ones(n, bool)
    live = np.arange(len(doc))
    pending = _next_gap(shingle, arrival, weight)
    while True:
        moving = live
        while len(moving):
            time[moving] += pending[moving]
            held = time[moving] <= limit[doc[moving]]
            # An arrival beyond the limit waits there, should the limit grow.
            time[moving[~held]] -= pending[moving[~held]]
            moving = moving[held]
            if not len(moving):
                break
            register = (_mix(shingle[moving] + (arrival[moving] * np.uint64(2) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)) % np.uint64(m)).astype(np.int64)
            d, t = doc[moving], time[moving]
            # The earliest of the arrivals at each register: in reverse order of time, the last write stays.
            order = np.argsort(-t, kind="stable")
            d, register, t, who = d[order], register[order], t[order], shingle[moving][order]
            better = t < early[d, register]
            early[d[better], register[better]] = t[better]
            owner[d[better], register[better]] = who[better]
            arrival[moving] += np.uint64(1)
            pending[moving] = _next_gap(shingle[moving], arrival[moving], weight[moving])
        open_docs = np.isinf(early).any(axis=1)
        if not open_docs.any():
            return owner
        limit[open_docs] *= 1.5
        live = np.flatnonzero(open_docs[doc])


def _next_gap(shingle: np.ndarray, arrival: np.ndarray, weight: np.ndarray) -> np.ndarray:
    bits = _mix(shingle ^ _mix(arrival * np.uint64(2) * np.uint64(0xA0761D6478BD642F) + np.uint64(0xE7037ED1A0B428DB)))
    return -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight


def _keys(words: np.ndarray, sizes: np.ndarray) -> list:
    """128 bits of each text's words in order; None where there is none."""
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(words)) - np.repeat(starts, sizes)).astype(np.uint64)
    own = np.flatnonzero(sizes)
    halves = []
    for seed in (0x2545F4914F6CDD1D, 0x369DEA0F31A53F85):
        mixed = _mix(_mix(words + np.uint64(seed)) + place * np.uint64(seed))
        halves.append(np.add.reduceat(mixed, starts[own]) if len(own) else mixed[:0])
    keys: list = [None] * len(sizes)
    for i, at in enumerate(own):
        keys[at] = halves[0][i].tobytes() + halves[1][i].tobytes()
    return keys


def _registers(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted registers of n documents, those with all weights 1, and which documents have a repeated shingle."""
    weighted = signatures(doc, shingle, weight, n)
    repeated = np.zeros(n, bool)
    repeated[doc[weight > 1]] = True
    plain = weighted.copy()
    if repeated.any():
        own, number = repeated[doc], np.cumsum(repeated) - 1
        plain[repeated] = signatures(number[doc[own]], shingle[own], np.ones(int(own.sum())), int(repeated.sum()))
    return weighted, plain, repeated


def _node_rows(texts: pa.Array) -> tuple[list, list, list]:
    """Key of the words, buckets and signature bytes (of both sets, where they differ) of each text; None where there is no word."""
    words, sizes = word_hashes(texts)
    doc, shingle, weight = shingles(words, sizes)
    own = np.flatnonzero(sizes)
    small = np.cumsum(sizes > 0) - 1
    weighted, plain, repeated = _registers(small[doc], shingle, weight, len(own))
    buckets, marks = [], []
    for owner in (weighted, plain):
        hashed = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(own), BANDS))
        for k in range(ROWS):
            hashed = _mix(hashed * np.uint64(0x9E3779B97F4A7C15) + owner[:, k::ROWS])
        buckets.append(hashed.view(np.int64))
        marks.append((_mix(owner) & np.uint64(0xFF)).astype(np.uint8))
    bucket_rows, mark_rows = [None] * len(sizes), [None] * len(sizes)
    for i, at in enumerate(own):
        sets = 2 if repeated[i] else 1
        bucket_rows[at] = np.unique(np.concatenate([held[i] for held in buckets[:sets]]))
        mark_rows[at] = b"".join(held[i].tobytes() for held in marks[:sets])
    return _keys(words, sizes), bucket_rows, mark_rows


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, key, buckets, marks of every row; the key is null where the text has no word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                made = _node_rows(part["text"].cast(pa.large_string()))
                kinds = (pa.binary(), pa.list_(pa.int64()), pa.binary())
                arrays = [part["doc_id"], *(pa.array(c, k) for c, k in zip(made, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "buckets", "marks"])
                pa.default_memory_pool().release_unused()

    schema = "doc_id long, key binary, buckets array<long>, marks binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about BLOCK_WORDS words by the texts' bytes."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes) // (6 * BLOCK_WORDS)
    for block in np.unique(at):
        start, end = np.searchsorted(at, [block, block + 1])
        yield batch.slice(start, end - start)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of Jaccard's share of distinct shingles and the probability Jaccard similarity of the weighted ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    if plain >= THRESHOLD:
        return plain
    x, y = a[1][i], b[1][j]
    # Each common shingle d counts 1 / sum over all e of max(x_e / x_d, y_e / y_d). The shingles for which x_e / x_d is the larger
    # are those with y_e / x_e below y_d / x_d: sort by the ratio, and sum from either side.
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    below_x = np.cumsum(x[order])
    above_y = y[order].sum() - np.cumsum(y[order])
    alone_x, alone_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    total = (below_x + alone_x) / x[order] + (above_y + alone_y) / y[order]
    return max(plain, float((1 / total).sum()))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of nodes whose shingles (node, shingles, weights) are similar enough; they travel once for each pair."""
    left = texts.toDF("a", "shingles_a", "weights_a")
    right = texts.toDF("b", "shingles_b", "weights_b")
    both = pairs.select("a", "b").distinct().join(right, "b").join(left, "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (_sets(batch[f"shingles_{s}"], batch[f"weights_{s}"]) for s in "ab")
            keep = [similarity(x, y) >= threshold for x, y in zip(one, other)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "shingles_a", "weights_a", "shingles_b", "weights_b").mapInArrow(check, "a long, b long")


def _sets(shingle: pa.ListArray, weight: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingles and their weights, row by row."""
    flat, heavy = shingle.flatten().to_numpy(), weight.flatten().to_numpy()
    ends = np.cumsum(pc.list_value_length(shingle).to_numpy())
    for start, end in zip(np.append(0, ends[:-1]), ends):
        yield flat[start:end], heavy[start:end]


def classes(links: DataFrame, limit: int = 60) -> DataFrame:
    """node, root: the least node of each connected component, for the nodes that have a link (a, b).

    Every node points to a node that is not larger. In a round it takes the least pointer of its neighbours, and pointers are
    then followed twice; paths shorten by a factor each round.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")), "roots")
    for _ in range(limit):
        near = both.join(state, both["b"] == state["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        joined = state.join(near, "node")
        # The node's old root hears of the new one too, so whole trees move and not only their leaves.
        heard = joined.select(F.col("root").alias("node"), F.col("near").alias("root"))
        own = joined.select("node", F.least("root", "near").alias("root"))
        moved = own.unionByName(heard).groupBy("node").agg(F.min("root").alias("root"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = moved.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"))
        after = stored(after, "roots")
        before = state.withColumnRenamed("root", "was")
        if after.join(before, "node").where(F.col("root") != F.col("was")).isEmpty():
            return after
        state = after
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id, n_links of every document; n_links counts the verified links of its text to other texts."""
    rows = stored(nodes(docs), "neardup-rows")
    worded = rows.where(F.col("key").isNotNull())
    by_key = worded.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("buckets").alias("buckets"), F.first("marks").alias("marks"))
    # Stored, so a node's number is given once.
    by_key = stored(by_key.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")
    bands = by_key.select("node", F.explode("buckets").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    members = stored(bands.join(shared, "bucket"), "neardup-members")
    company = stored(members.groupBy("node").agg(F.sum("members").alias("company")), "neardup-company")
    # Only texts that share a bucket are compared.
    wanted = company.select("node").join(by_key.select("node", "key", "doc_id"), "node")
    texts = stored(_texts(docs, wanted), "neardup-texts")

    marks = wanted.select("node").join(by_key.select("node", "marks"), "node")
    members = stored(members.join(company, "node").select("node", "bucket", "company"), "neardup-members")
    links = roots = None
    for turn in range(rounds):
        held = _rooted(members, roots)
        rank = F.struct("company", F.xxhash64("node")) if turn == 0 else F.struct(F.xxhash64("node", "bucket", F.lit(turn)))
        first = F.max_by("node", rank).alias("leader"), F.max_by("root", rank).alias("leader_root")
        led = held.groupBy("bucket").agg(*first, F.min("root").alias("r0"), F.max("root").alias("r1"))
        led = led.where(F.col("r0") != F.col("r1")).select("bucket", "leader", "leader_root")
        met = held.join(led, "bucket").where(F.col("root") != F.col("leader_root"))
        pairs = _likely(met.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), marks, threshold)
        found = stored(verified(pairs, texts, threshold), "neardup-links")
        links = found if links is None else links.unionByName(found)
        roots = classes(links)
    rest = _likely(_residual(members, roots, texts, threshold), marks, threshold)
    rest = stored(verified(rest, texts, threshold), "neardup-links")
    links = links.unionByName(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(links, "neardup-links")
    roots = classes(links)

    ends = links.select(F.col("a").alias("node")).union(links.select("b"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = by_key.select("node", "key", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    by_node = named.join(least, "root").join(degree, "node", "left")
    by_node = by_node.select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    answer = worded.select("doc_id", "key").join(by_node, "key").select("doc_id", "class_id", "n_links")
    alone = rows.where(F.col("key").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return answer.unionByName(alone)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles, weights) of the wanted (node, key, doc_id): what is compared, made once from the whole texts."""
    one = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    found = one.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                words, sizes = word_hashes(part["text"].cast(pa.large_string()))
                doc, shingle, weight = shingles(words, sizes)
                ends = np.searchsorted(doc, np.arange(len(sizes) + 1))
                arrays = [part["node"]]
                for flat, kind in ((shingle.view(np.int64), pa.int64()), (weight.astype(np.float32), pa.float32())):
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind)))
                same = pc.fill_null(pc.equal(pa.array(_keys(words, sizes), pa.binary()), part["key"].cast(pa.binary())), False)
                yield pa.RecordBatch.from_arrays(arrays, ["node", "shingles", "weights"]).filter(same)

    # An id may stand at several texts, of which one has the key, and a row may be repeated.
    matching = found.select("node", "key", "text").mapInArrow(own, "node long, shingles array<long>, weights array<float>")
    return matching.dropDuplicates(["node"])


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _residual(members: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs in different classes that may be linked, of nodes with a bucket that holds several classes.

    A node's shingles are ordered by the number of nodes that have them, rarest first. If a pair has no shingle in common before a
    place, what it has in common lies from there on in both. With n shingles in all and r of them from the place on (w: their share of the weight):

    - plain Jaccard >= t needs r >= t / (1 + t) * (n_a + n_b) on both sides, so r >= t * n, and for the smaller one r >= 2t / (1 + t) * n;
    - probability Jaccard is at most the smaller w, so it needs w >= t on both sides. Without a repeated shingle in either it is the plain one.

    So every linked pair meets in its first common shingle, where one side is `narrow` by the stricter bound (or has repeated
    shingles) and the other `wide`. Only shingles of two nodes or more are joined.
    """
    held = _rooted(members, roots).select("bucket", "node", "root")
    several = held.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    split = held.join(several.where(F.col("r0") != F.col("r1")).select("bucket"), "bucket").select("node", "root").distinct()
    split = stored(split, "neardup-split")
    # A slack for the rounding of sums of float weights.
    slack, least, strict = 1e-4, threshold, 2 * threshold / (1 + threshold)
    rows = texts.join(split.select("node"), "node").select("node", F.posexplode("shingles").alias("at", "shingle"), "weights")
    rows = rows.select("node", "shingle", F.get("weights", F.col("at")).cast("double").alias("weight"))
    rows = stored(rows, "neardup-shingles")
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > 1)
    rows = rows.join(common, "shingle", "left").withColumn("nodes", F.coalesce("nodes", F.lit(1)))
    whole = Window.partitionBy("node")
    rest = whole.orderBy(F.desc("nodes"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("node", "shingle", "nodes", F.count(F.lit(1)).over(rest).alias("r"), F.sum("weight").over(rest).alias("w"),
                       F.count(F.lit(1)).over(whole).alias("n"), F.sum("weight").over(whole).alias("total"))
    repeated = F.col("total") > F.col("n") + slack
    heavy = F.col("w") / F.col("total") >= least - slack
    rows = rows.where((F.col("nodes") > 1) & ((F.col("r") >= (least - slack) * F.col("n")) | heavy))
    rows = rows.select("node", "shingle", "r", "n", (F.col("w") / F.col("total")).alias("share"), repeated.alias("repeated"))
    rows = stored(rows.join(split, "node"), "neardup-prefixes")
    narrow = rows.where(F.col("repeated") | (F.col("r") >= (strict - slack) * F.col("n")))
    names = ["r", "n", "share", "repeated", "root"]
    one = narrow.select("shingle", F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in names))
    two = rows.select("shingle", F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in names))
    plain = F.least("r_a", "r_b") >= (least / (1 + least) - slack) * (F.col("n_a") + F.col("n_b"))
    weighted = (F.col("repeated_a") | F.col("repeated_b")) & (F.least("share_a", "share_b") >= least - slack)
    pairs = one.join(two, "shingle").where((F.col("root_a") != F.col("root_b")) & (plain | weighted))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _likely(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The pairs of which the weighted or the plain signatures leave the threshold possible: a byte of each register is compared."""
    both = pairs.join(marks.toDF("b", "marks_b"), "b").join(marks.toDF("a", "marks_a"), "a")
    least = threshold - DEVIATIONS * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def agreement(batch: pa.RecordBatch, of: slice) -> np.ndarray:
        held = [np.frombuffer(b"".join(m[of] for m in batch[c].to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("marks_a", "marks_b")]
        return (held[0] == held[1]).mean(axis=1)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The weighted marks come first and the plain ones last; where they are the same there is one set.
            near = np.maximum(agreement(batch, slice(0, REGISTERS)), agreement(batch, slice(-REGISTERS, None))) >= least
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "marks_a", "marks_b").mapInArrow(likely, "a long, b long")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """One document of each class, the one whose id is its class id, with its own columns."""
    found = near_duplicates(docs.select("doc_id", "text"), threshold, rounds)
    gone = found.where(F.col("doc_id") != F.col("class_id")).select("doc_id")
    gone = gone.join(found.where(F.col("doc_id") == F.col("class_id")).select("doc_id"), "doc_id", "left_anti").distinct()
    return docs.join(gone.withColumnRenamed("doc_id", ADDED), F.col("doc_id") == F.col(ADDED), "left_anti")
