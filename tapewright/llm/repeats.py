"""Removal of every byte covered by a string of LENGTH bytes that starts somewhere else too, by suffix arrays of shards.

Each string of LENGTH bytes has a key, the least hash of the grams of GRAM bytes in it, so equal strings have equal keys. Neighbouring starts of
one key are a run; a run and the bytes its strings reach are a region. A key with one run, and that without a second place of its gram, has no repeat
and goes no further. Equal regions of a key are joined to one with the number of their texts, as are equal texts at the outset.

The regions left are dealt to shards by key. A shard's suffix array is refined as Larsson and Sadakane do, Kasai's scan gives the common
prefixes of neighbours, and neighbours that share LENGTH bytes are one string; a string of weight two or more marks its starts. A key whose regions are too
many for a shard is spread over all shards: each then lists its distinct strings' digests in order, the lists are merged by binary search in
slices of the digests' range, and a string that two shards hold marks its start in both.

Texts are read for the keys, once more for the regions, and once more to be cut. What moves besides is narrow: a row for each run. No task holds
more than a shard, a slice, or one text and its runs; runs of a hot key or region are only counted and joined with one row. Digests are BLAKE2 of 128 bits.

Defined results: texts are their UTF-8 bytes; a null text is empty; a cut may fall inside a character. Texts shorter than LENGTH stay whole. Repeated rows and equal texts
repeat each other whatever their ids. Null ids stay. An empty table gives no row. Extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.suffixes import Shard, merge_runs
from tapewright.llm.tables import stored

LENGTH = 400
GRAM = 64
#: Grams in a string.
WINDOW = LENGTH - GRAM + 1
#: Bytes that are hashed together, starts in a run, bytes in a shard, digests in a slice.
BUFFER = 1 << 20
LONGEST_RUN = 1024
SHARD = 1 << 20
SLICE = 1 << 18
SALTS = 8

RUN = "key long, region binary, again boolean, id long, at long, n int, copies long"
FOUND = "key long, region binary, spans array<int>, witness binary, place int, shard long"


# ---- keys and runs -----------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_BASE = 0x9E3779B97F4A7C15
#: Powers of the base and of its inverse, as many as the largest buffer so far needs.
_TABLES: list[np.ndarray] = []


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    n = len(data)
    if not _TABLES or len(_TABLES[0]) < n:
        _TABLES[:] = [_powers(base, max(n, 2 * BUFFER)) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _TABLES[0][:n], out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _TABLES[1][: n - GRAM + 1]
    grams = (grams ^ (grams >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    grams = (grams ^ (grams >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return grams ^ (grams >> np.uint64(31))


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """Least of each `window` consecutive values."""
    span, low = 1, values
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(values) - window + 1
    return np.minimum(low[:n], low[window - span : window - span + n])


def runs_of(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """(piece, start in it, starts, key, second place) of the runs of several pieces of at least LENGTH bytes each."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    first = np.cumsum(sizes) - sizes
    last = first + sizes - LENGTH + 1
    grams = gram_hashes(data)
    keys = window_minima(grams, WINDOW)
    edge = np.zeros(len(keys) + 1, bool)
    edge[1:-1] = keys[1:] != keys[:-1]
    # Starts from `last` on would reach into the next piece.
    edge[first] = edge[last] = True
    edge[-1] = True
    edges = np.flatnonzero(edge)
    start, end = edges[:-1], edges[1:]
    piece = np.searchsorted(first, start, side="right") - 1
    real = start < last[piece]
    start, end, piece = start[real], end[real], piece[real]
    if (end - start > LONGEST_RUN).any():
        cut = [(k, s) for k in range(len(start)) for s in range(start[k], end[k], LONGEST_RUN)]
        which = np.array([k for k, _ in cut])
        start, end, piece = np.array([s for _, s in cut]), end[which], piece[which]
        end = np.minimum(end, start + LONGEST_RUN)
    again = np.zeros(len(start), bool)
    windows = sliding_window_view(grams, WINDOW)
    for k in range(0, len(start), 2048):
        s, e = start[k : k + 2048], end[k : k + 2048] - 1
        leftmost = s + windows[s].argmin(axis=1)
        rightmost = e + WINDOW - 1 - windows[e][:, ::-1].argmin(axis=1)
        again[k : k + 2048] = leftmost != rightmost
    return piece, start - first[piece], end - start, keys[start].view(np.int64), again


def _runs(texts: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, whose, held = [], [], 0
        for batch in batches:
            for key, copies, text in zip(batch["id"].to_pylist(), batch["copies"].to_pylist(), batch["text"]):
                text = text.as_py()
                for base in range(0, len(text) - LENGTH + 1, BUFFER - LENGTH + 1):
                    pieces.append(text[base : base + BUFFER])
                    whose.append((key, base, copies))
                    held += len(pieces[-1])
                    if held >= BUFFER:
                        yield emit(pieces, whose)
                        pieces, whose, held = [], [], 0
        if pieces:
            yield emit(pieces, whose)

    def emit(pieces: list[bytes], whose: list[tuple]) -> pa.RecordBatch:
        piece, start, n, key, again = runs_of(pieces)
        ids, bases, copies = (np.array(c, np.int64) for c in zip(*whose))
        ends = start + n + LENGTH - 1
        regions = [_digest(pieces[p][s:e]) for p, s, e in zip(piece.tolist(), start.tolist(), ends.tolist())]
        columns = [key, regions, again, ids[piece], bases[piece] + start, n.astype(np.int32), copies[piece]]
        names = ["key", "region", "again", "id", "at", "n", "copies"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if c is regions else pa.array(c) for c in columns], names)

    return texts.select("id", "copies", "text").mapInArrow(find, RUN)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


# ---- shards ------------------------------------------------------------------------------------


def repeated_starts(regions: list[bytes], weights: list[int], spread: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts that repeat, starts that are alone here but may repeat in other shards, one start of each string of a spread region).

    Starts are (region, place) rows.
    """
    shard = Shard(regions)
    order, rank = shard.suffix_array()
    shared = shard.common_prefixes(order, rank, LENGTH)[order] >= LENGTH
    string = np.cumsum(~shared) - 1
    region = shard.region[order]
    weight = np.bincount(string, weights=np.array(weights, np.float64)[region])
    starts = order + LENGTH <= shard.mark[order]
    repeated = starts & (weight[string] >= 2)
    wide = starts & np.array(spread, bool)[region]

    def rows(chosen: np.ndarray) -> np.ndarray:
        at = np.sort(order[chosen])
        return np.stack([shard.region[at].astype(np.int64), at - shard.bases[shard.region[at]]], axis=1)

    return rows(repeated), rows(wide & ~repeated), rows(wide & ~shared & repeated)


def _spans(places: np.ndarray) -> list[int]:
    """Runs of consecutive places as start, end, start, end, ..."""
    cuts = np.flatnonzero(np.diff(places) != 1)
    return np.stack([places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)] + 1], axis=1).ravel().tolist()


def _search_shard(table: pa.Table) -> pa.Table:
    keys, names, bodies = table["key"].to_pylist(), table["region"].to_pylist(), table["body"].to_pylist()
    spread = table["spread"].to_pylist()
    repeated, alone, others = repeated_starts(bodies, table["weight"].to_pylist(), spread)
    rows = []
    owners, first = np.unique(repeated[:, 0], return_index=True)
    for r, places in zip(owners.tolist(), np.split(repeated[:, 1], first[1:])):
        rows.append((keys[r], names[r], _spans(places), None, None, None))
    shard = table["bucket"][0].as_py() if len(table) else None
    for places, known in ((alone, False), (others, True)):
        for r, p in places.tolist():
            rows.append((keys[r], names[r], None, _digest(bodies[r][p : p + LENGTH]), None if known else p, shard))
    return _table(rows)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "region", "spans", "witness", "place", "shard"])


def _merge_slice(table: pa.Table) -> pa.Table:
    """Starts whose strings are listed by two shards or more."""
    witness = np.array(table["witness"].to_pylist(), "S16")
    shard = table["shard"].to_numpy()
    runs = []
    by_shard = np.argsort(shard, kind="stable")
    for at in np.split(by_shard, np.flatnonzero(np.diff(shard[by_shard])) + 1):
        values = np.unique(witness[at])
        runs.append((values, np.ones(len(values), np.int64)))
    values, counts = merge_runs(runs)
    twice = counts[np.searchsorted(values, witness)] >= 2
    open_starts = table.column("place").is_valid().to_numpy()
    rows = table.filter(pa.array(twice & open_starts))
    spans = [[p, p + 1] for p in rows["place"].to_pylist()]
    return _table(list(zip(rows["key"].to_pylist(), rows["region"].to_pylist(), spans, *[[None] * len(spans)] * 3)))


def _cut_regions(wanted: DataFrame) -> DataFrame:
    """The bytes of regions, from rows of a text and its list of regions."""
    schema = "bucket long, key long, region binary, weight long, spread boolean, body binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for text, regions in zip(batch["text"], batch["regions"]):
                text = text.as_py()
                for r in regions.as_py():
                    rows.append((r["bucket"], r["key"], r["region"], r["weight"], r["spread"], text[r["at"] : r["at"] + r["n"] + LENGTH - 1]))
                    held += len(rows[-1][-1])
                    if held > BUFFER * 4:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "key", "region", "weight", "spread", "body"])

    return wanted.select("text", "regions").mapInArrow(cut, schema)


# ---- whole tables ------------------------------------------------------------------------------


def _marks(texts: DataFrame) -> DataFrame:
    """(id, at, spans): for each run with repeats, where it lies and which of its starts repeat."""
    runs = stored(_runs(texts), "repeat-runs")
    keys = runs.groupBy("key").agg(F.sum("copies").alias("total"), F.max("again").alias("again")).where("total > 1 OR again")
    hits = stored(runs.drop("again").join(keys.select("key"), "key", "left_semi"), "repeat-hits")
    regions = hits.groupBy("key", "region").agg(F.sum("copies").alias("weight"), F.min(F.struct("id", "at", "n")).alias("at"))
    regions = stored(regions.select("key", "region", "weight", "at.*"), "repeat-regions")

    size = F.sum(F.col("n") + LENGTH - 1)
    loads = regions.groupBy("key").agg(size.alias("bytes"))
    total = regions.agg(size).first()[0] or 0
    buckets = max(1, -(-total // SHARD))
    heavy = loads.where(F.col("bytes") > SHARD).select("key", F.lit(True).alias("heavy"))
    spread = F.coalesce("heavy", F.lit(False))
    home = F.when(spread, F.xxhash64("key", "region")).otherwise(F.xxhash64("key"))
    dealt = regions.join(heavy, "key", "left").withColumns({"spread": spread, "bucket": F.pmod(home, F.lit(buckets))})
    lists = dealt.groupBy("id").agg(F.collect_list(F.struct("at", "n", "key", "region", "weight", "spread", "bucket")).alias("regions"))
    shards = _cut_regions(texts.select("id", "text").join(lists, "id"))
    found = stored(shards.groupBy("bucket").applyInArrow(_search_shard, FOUND), "repeat-found")

    listed = found.where(F.col("witness").isNotNull())
    slices = max(1, -(-listed.count() // SLICE))
    across = listed.groupBy(F.pmod(F.xxhash64("witness"), F.lit(slices))).applyInArrow(_merge_slice, FOUND)
    marks = found.where(F.col("spans").isNotNull()).unionByName(across)
    marks = marks.groupBy("key", "region").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return hits.select("key", "region", "id", "at").join(marks, ["key", "region"]).select("id", "at", "spans")


def _cut_texts(marked: DataFrame, with_text: bool) -> DataFrame:
    schema = "digest string, spans array<struct<start:long,end:long>>, n_removed long, kept_sha256 string" + ", kept binary" * with_text
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text, marks in zip(batch["digest"].to_pylist(), batch["text"], batch["marks"]):
                text = text.as_py()
                removed = removed_spans(marks.as_py())
                edges = [0, *(x for pair in removed for x in pair), len(text)]
                kept = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                spans = [{"start": s, "end": e} for s, e in removed]
                columns = [pa.array([digest]), pa.array([spans], span), pa.array([len(text) - len(kept)]), pa.array([hashlib.sha256(kept).hexdigest()])]
                if with_text:
                    columns.append(pa.array([kept], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["digest", "spans", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return marked.select("digest", "text", "marks").mapInArrow(cut, schema)


def removed_spans(marks: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked strings cover."""
    starts = np.concatenate([m["at"] + np.array(m["spans"][::2], np.int64) for m in marks])
    ends = np.concatenate([m["at"] + np.array(m["spans"][1::2], np.int64) for m in marks]) + LENGTH - 1
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(first)
    return list(zip(starts[at].tolist(), reach[np.append(at[1:], len(starts)) - 1].tolist()))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of the removed bytes) of every row, and the kept bytes if asked."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", text.alias("text"))
    long_rows = rows.where(F.octet_length("text") >= LENGTH)
    texts = long_rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = stored(texts.withColumn("id", F.monotonically_increasing_id()), "repeat-texts")
    marks = _marks(texts).groupBy("id").agg(F.collect_list(F.struct("at", "spans")).alias("marks"))
    cut = stored(_cut_texts(texts.join(marks, "id"), with_text), "repeat-cuts")

    # Copies of one text may be most rows: they are spread over salts, and each text's result is there for every salt.
    own = rows.select("doc_id", *(["text"] if with_text else []), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = own.join(cut, ["digest", "salt"], "left")
    none = F.array().cast("array<struct<start:long,end:long>>")
    out = joined.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
        F.coalesce("spans", none).alias("spans"),
        *([F.coalesce("kept", "text").alias("kept")] if with_text else []),
    )
    return out
