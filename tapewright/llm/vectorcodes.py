"""Compression of vectors to codes of one entry a part, exact in integers, over Hilbert-sorted blocks.

Components become integers, a vector is cut into PARTS equal parts, and each part position has a codebook of ENTRIES entries: the parts of the
vectors of smallest id, improved for a number of rounds by assigning every part to its nearest entry and moving each entry to the floor of
its parts' mean. Then all parts are assigned once more.

A task writes its vectors in chunks. In a chunk each part position has an order of its own, along a Hilbert curve, cut into flat blocks
of BLOCK points with the block's least and greatest components (its box) and its sums. In every round the distances between a box and the entries
leave a short list of entries for the block: an entry farther at its nearest than another at its farthest can be nearest to none of
the points. A block with one entry left adds its stored sums; the points of the others meet the short list in integer kernels, blocks of
similar short lists together. Tasks send sums by part and entry, which Spark adds up; the driver gets the codebooks, whose size
is fixed by the parameters and the vectors' width.

No vector is shuffled. A chunk holds CHUNK components, so a task's memory does not grow with the table. Sums are integers, so the result
does not depend on how rows are dealt to tasks.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped. An empty vector is kept. Vectors are filled
up with zeros to PARTS times the part's width, which is that of the longest. Components are held to +-LIMIT (floats up to 65,536 at scale 256), so that all sums stay exact.
The vectors of smallest id are taken row by row, ties by their components, null ids last; fewer rows than ENTRIES make fewer entries.
A repeated row is coded each time. An empty table has no codebook and no row. Extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tapewright.llm.tables import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK = 32
CHUNK = 1 << 21
LIMIT = 1 << 24
#: Bits of a place on the curve.
CURVE_BITS = 60
SALTS = 16


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component) of every component; null for a vector that is dropped."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT))
    return F.when(whole, F.transform(vector, lambda x: held(x).cast("int")))


# ---- blocks ------------------------------------------------------------------------------------


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of coordinates below 2 ** bits."""
    axes = [places[:, j].astype(np.int64) for j in range(places.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for j in range(len(axes)):
            set_here = (axes[j] & q) != 0
            swap = np.where(set_here, 0, (axes[0] ^ axes[j]) & p)
            axes[0] = np.where(set_here, axes[0] ^ p, axes[0] ^ swap)
            if j:
                axes[j] = axes[j] ^ swap
        q >>= 1
    for j in range(1, len(axes)):
        axes[j] = axes[j] ^ axes[j - 1]
    turn, q = np.zeros(len(places), np.int64), 1 << (bits - 1)
    while q > 1:
        turn = np.where((axes[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros(len(places), np.int64)
    for bit in reversed(range(bits)):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


def curve_order(points: np.ndarray) -> np.ndarray:
    """Order of the points along a curve over their own range; wide parts use the components that spread most."""
    low, spread = points.min(axis=0), np.ptp(points, axis=0)
    used = np.argsort(-spread, kind="stable")[: min(points.shape[1], CURVE_BITS // 4)]
    bits = min(15, CURVE_BITS // max(1, len(used)))
    scaled = (points[:, used] - low[used]) * ((1 << bits) - 1) // np.maximum(spread[used], 1)
    return np.argsort(hilbert(scaled, bits), kind="stable") if len(used) else np.arange(len(points))


class Blocks:
    """One part position's points in blocks: (blocks, BLOCK, width), the last filled up with its last point."""

    def __init__(self, points: np.ndarray, n: int, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.n, self.low, self.high, self.sums = points, n, low, high, sums

    @staticmethod
    def of(points: np.ndarray) -> Blocks:
        n, width = points.shape
        filled = np.concatenate([points, np.repeat(points[-1:], -n % BLOCK, axis=0)]).reshape(-1, BLOCK, width)
        sums = filled.sum(axis=1, dtype=np.int64)
        sums[-1] -= points[-1].astype(np.int64) * (-n % BLOCK)
        return Blocks(filled, n, filled.min(axis=1), filled.max(axis=1), sums)

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """For each block, which entries can be nearest to one of its points."""
        below, above = self.low[:, None, :].astype(np.int64) - entries, entries - self.high[:, None, :].astype(np.int64)
        nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        farthest = (np.maximum(-below, -above) ** 2).sum(axis=2)
        return nearest <= farthest.min(axis=1, keepdims=True)

    def nearest(self, entries: np.ndarray, with_distance: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Entry of every point (blocks, BLOCK), its squared distance, and which blocks have one entry left."""
        listed = self.shortlists(entries)
        length = listed.sum(axis=1)
        # Listed entries first, in ascending order, so that the first of equal distances is the lower index.
        ranked = np.argsort(~listed, axis=1, kind="stable")
        choice = np.repeat(ranked[:, :1], BLOCK, axis=1)
        distance = np.zeros(choice.shape, np.int64) if with_distance else None
        size = 1
        while size < 2 * len(entries):
            at = np.flatnonzero((length > size // 2) & (length <= size))
            if len(at) and (size > 1 or with_distance):
                short = ranked[at, : min(size, len(entries))]
                found = self._kernel(at, entries[short])
                found[np.arange(short.shape[1])[None, None, :] >= length[at][:, None, None] + np.zeros((1, BLOCK, 1), np.int64)] = np.iinfo(np.int64).max
                best = found.argmin(axis=2)
                choice[at] = np.take_along_axis(short, best, axis=1)
                if with_distance:
                    distance[at] = np.take_along_axis(found, best[:, :, None], axis=2)[:, :, 0]
            size *= 2
        return choice, distance, length == 1

    def _kernel(self, at: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Squared distances of the blocks' points to their short lists."""
        total = np.zeros((len(at), BLOCK, short.shape[1]), np.int64)
        for j in range(self.points.shape[2]):
            apart = self.points[at, :, None, j].astype(np.int64) - short[:, None, :, j]
            total += apart * apart
        return total

    def moved(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the points nearest to each entry."""
        choice, _, alone = self.nearest(entries, with_distance=False)
        width = self.points.shape[2]
        sizes = np.full(len(choice), BLOCK)
        sizes[-1] -= -self.n % BLOCK
        count, sums = np.zeros(len(entries), np.int64), np.zeros((len(entries), width), np.int64)
        np.add.at(count, choice[alone, 0], sizes[alone])
        np.add.at(sums, choice[alone, 0], self.sums[alone])
        real = ~alone[:, None] & (np.arange(BLOCK)[None, :] < sizes[:, None])
        np.add.at(count, choice[real], 1)
        np.add.at(sums, choice[real], self.points[real].astype(np.int64))
        return count, sums


# ---- chunks in Spark ---------------------------------------------------------------------------


def _chunk_schema(rows: DataFrame) -> StructType:
    kept = [StructField(n, ArrayType(rows.schema[n].dataType)) for n in ("vec_id", "label")]
    return StructType([*kept, *(StructField(n, BinaryType()) for n in ("order", "points", "low", "high", "sums"))])


def _chunks(rows: DataFrame, width: int) -> DataFrame:
    """One row for each chunk: its ids and labels, and by part the order, the sorted points, boxes and sums."""
    per_chunk = max(BLOCK, CHUNK // (PARTS * width))

    def built(batch: pa.Table) -> pa.RecordBatch:
        lists = batch["ints"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        matrix = np.zeros((len(sizes), PARTS * width), np.int32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
        held: dict[str, list[bytes]] = {n: [] for n in ("order", "points", "low", "high", "sums")}
        for part in range(PARTS):
            points = np.ascontiguousarray(matrix[:, part * width : (part + 1) * width])
            order = curve_order(points.astype(np.int64)).astype(np.int32)
            blocks = Blocks.of(points[order])
            for name, values in (("order", order), ("points", blocks.points), ("low", blocks.low), ("high", blocks.high), ("sums", blocks.sums)):
                held[name].append(values.tobytes())
        columns = [pa.ListArray.from_arrays([0, len(sizes)], batch[n].combine_chunks()) for n in ("vec_id", "label")]
        columns += [pa.array([b"".join(held[n])], pa.binary()) for n in held]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", *held])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, per_chunk - n)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                n += part.num_rows
                if n == per_chunk:
                    yield built(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
        if n:
            yield built(pa.Table.from_batches(waiting))

    return stored(rows.mapInArrow(gather, _chunk_schema(rows)), "vector-chunks")


def _parts(chunk: dict, width: int) -> Iterator[tuple[np.ndarray, Blocks]]:
    """(order, blocks) of each part position of a chunk."""
    n = len(chunk["order"]) // (4 * PARTS)
    order = np.frombuffer(chunk["order"], np.int32).reshape(PARTS, n)
    low, high = (np.frombuffer(chunk[name], np.int32).reshape(PARTS, -1, width) for name in ("low", "high"))
    points = np.frombuffer(chunk["points"], np.int32).reshape(PARTS, -1, BLOCK, width)
    sums = np.frombuffer(chunk["sums"], np.int64).reshape(PARTS, -1, width)
    for part in range(PARTS):
        yield order[part], Blocks(points[part], n, low[part], high[part], sums[part])


_BINARIES = ["order", "points", "low", "high", "sums"]


def _round(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one round."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for chunk in batch.to_pylist():
                for part, (_, blocks) in enumerate(_parts(chunk, width)):
                    count, sums = blocks.moved(books[part])
                    total[part, :, 0] += count
                    total[part, :, 1:] += sums
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["place", "value"])

    found = chunks.select(*_BINARIES).mapInArrow(add, "place long, value long").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for place, value in found.collect():  # as many rows as the codebooks have components and counts
        total[place] = value
    total = total.reshape(parts, entries, width + 1)
    count = total[:, :, :1]
    return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)


class Codebooks:
    """Codebooks and the chunks they were made of."""

    def __init__(self, books: np.ndarray, chunks: DataFrame):
        self.books, self.chunks = books, chunks

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of (vec_id, label, ints); None for a table without vectors."""
    rows = vectors.where(F.col("ints").isNotNull()).select("vec_id", "label", "ints")
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()
    if not seeds:
        return None
    longest = rows.agg(F.max(F.size("ints"))).first()[0]
    width = max(1, -(-longest // PARTS))
    books = np.zeros((len(seeds), PARTS * width), np.int64)
    for i, seed in enumerate(seeds):
        books[i, : len(seed.ints)] = seed.ints
    books = np.ascontiguousarray(books.reshape(-1, PARTS, width).transpose(1, 0, 2))
    chunks = _chunks(rows, width)
    for _ in range(rounds):
        books = _round(chunks, books)
    return Codebooks(books, chunks)


def encode(model: Codebooks) -> DataFrame:
    """vec_id, label, code, error of every vector the codebooks were made of."""
    books, width = model.books, model.books.shape[2]
    kept = model.chunks.schema
    schema = StructType(
        [*(StructField(n, kept[n].dataType.elementType) for n in ("vec_id", "label")), StructField("code", StringType()), StructField("error", LongType())]
    )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.select(_BINARIES).to_pylist()):
                n = len(chunk["order"]) // (4 * PARTS)
                codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for part, (order, blocks) in enumerate(_parts(chunk, width)):
                    choice, distance, _ = blocks.nearest(books[part], with_distance=True)
                    codes[order, part] = choice.ravel()[:n]
                    error[order] += distance.ravel()[:n]
                whole = codes.tobytes().hex()
                digits = 2 * PARTS
                texts = pa.array([whole[k : k + digits] for k in range(0, len(whole), digits)], pa.string())
                own = [batch[name].slice(i, 1).flatten() for name in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*own, texts, pa.array(error)], schema.names)

    return model.chunks.mapInArrow(coded, schema)


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error (errors summed over equal labels), codebooks_sha256."""
    model = fit(vectors, entries, rounds)
    if model is None:
        empty = "code string, error long, label_error long, codebooks_sha256 string"
        kept = StructType([vectors.schema[n] for n in ("vec_id", "label")])
        return vectors.sparkSession.createDataFrame([], StructType([*kept, *vectors.sparkSession.createDataFrame([], empty).schema]))
    codes = stored(encode(model), "vector-codes")
    # A label may hold most rows, so rows are spread over salts and each label's sum is there for every salt.
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = codes.withColumn("salt", salt).alias("c").join(sums.alias("s"), F.expr("c.label <=> s.label AND c.salt = s.salt"))
    found = joined.select("c.vec_id", "c.label", "c.code", "c.error", "s.label_error")
    return found.withColumn("codebooks_sha256", F.lit(model.sha256()))
