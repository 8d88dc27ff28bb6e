"""Language of a text: the nearest of several centroids per language, by the cosine of TF-IDF letter n-grams.

Letters are lowered; runs of anything else become one separator; n-grams of one to three characters that lie
within a word (with its edges) are hashed into a fixed number of dimensions. Counts are dampened, weighted by inverse document
frequency and normalised. Each language's sample vectors are clustered (spherical k-means), so that a language written in
several registers keeps one centroid for each. A text goes to the nearest centroid; one that is farther from it than
nearly all of the language's own texts of such a length is rejected.

The floors are learned from texts that the clustering did not see: each of FOLDS parts of a language's sample is measured against
centroids of the others, whole and in pieces of every length class (a power of two of n-grams), for short texts are farther
from any centroid. A class's floor is the TAIL quantile of its similarities.

The fit reads a bounded sample of labelled rows (`per_language` of each language, chosen by a hash of the id);
prediction reads every whole text.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; so is every text if nothing could be
learned. Ties go to the language that sorts first. Repeated rows get equal answers. Texts of any length are read in blocks of
a million characters; a word that lies across two blocks counts as two.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.tables import ADDED, fold, kept, scored, small_sample, stored

BITS = 14
DIMS = 1 << BITS
BLOCK = 1 << 20
PER_LANGUAGE = 400
CENTROIDS = 4
ROUNDS = 12
LEAST_SHARE = 0.02
#: The share of a language's own texts that may be rejected, of each length class.
TAIL = 0.01
FOLDS = 4
#: Length classes by the power of two of a text's n-grams, and the characters of the pieces that stand for them.
CLASSES = 16
PIECES = tuple(2**n for n in range(1, 14))
#: Similarities that a class needs for a floor of its own.
LEAST_PIECES = 20
UNKNOWN = "und"

_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lowered text with 32 for each run of other characters, and at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _LETTER[np.minimum(codes, 0xFFFF)]
    for high in np.unique(codes[codes > 0xFFFF]):
        letter[codes == high] = chr(high).isalpha()
    codes = np.where(letter, codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def _slots(*parts: np.ndarray) -> np.ndarray:
    mixed = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        mixed = (mixed ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts by dimension over the whole text; None if it has no letter."""
    total = None
    for start in range(0, len(text), BLOCK):
        codes = letter_codes(text[start : start + BLOCK])
        if len(codes) < 3:
            continue
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        inner = b != 32
        slots = np.concatenate((_slots(b[inner]), _slots(codes[:-1], codes[1:]), _slots(a[inner], b[inner], c[inner])))
        found = np.bincount(slots, minlength=DIMS)
        total = found if total is None else total + found
    return total


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    norm = np.sqrt(weighted @ weighted)
    return (weighted / norm if norm > 0 else weighted).astype(np.float32)


def length_class(counts: np.ndarray) -> int:
    return min(CLASSES - 1, int(counts.sum()).bit_length() - 1)


@dataclass
class Centroids:
    languages: np.ndarray  # of each centroid
    matrix: np.ndarray  # centroid x dimension, rows of length 1
    floors: np.ndarray  # centroid x length class: least cosine that is accepted
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = ngram_counts(text) if text else None
        if counts is None or not len(self.languages):
            return UNKNOWN, 0.0, False
        near = self.matrix @ vector(counts, self.idf)
        best = int(np.argmax(near))
        return str(self.languages[best]), float(min(1.0, max(0.0, near[best]))), bool(near[best] >= self.floors[best, length_class(counts)])


def cluster(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids, and each vector's own. Seeds lie evenly in the order of similarity to the mean.

    A centroid that keeps less than LEAST_SHARE of the vectors is a stray text rather than a register, and is given up.
    """
    order = np.argsort(vectors @ vectors.mean(axis=0), kind="stable")
    places = (np.arange(min(k, len(vectors))) + 0.5) * len(vectors) / min(k, len(vectors))
    centres = vectors[order[places.astype(int)]]
    for step in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        sizes = np.bincount(own, minlength=len(centres))
        kept = [j for j in range(len(centres)) if sizes[j] and (step < rounds - 1 or sizes[j] >= LEAST_SHARE * len(vectors))]
        sums = np.stack([vectors[own == j].sum(axis=0) for j in kept])
        centres = (sums / np.linalg.norm(sums, axis=1, keepdims=True)).astype(np.float32)
    return centres, np.argmax(vectors @ centres.T, axis=1)


def pieces_of(text: str) -> list[str]:
    """The text, and a piece of it for each length that it exceeds, from a word's start at a place chosen by a hash."""
    found = [text]
    for size in PIECES:
        if size < len(text):
            start = zlib.crc32(f"{size} {text[:1000]}".encode("utf-8", "surrogatepass")) % (len(text) - size + 1)
            space = text.rfind(" ", 0, start + 1)
            found.append(text[space + 1 : space + 1 + size])
    return found


def class_floors(texts: list[str], vectors: np.ndarray, idf: np.ndarray, k: int) -> np.ndarray:
    """For each length class, the least similarity to centroids of other texts that all but TAIL of the texts and pieces reach.

    A class without enough of them takes the next shorter one's floor, the shortest the next longer one's. A single text is measured against itself.
    """
    found: list[list[float]] = [[] for _ in range(CLASSES)]
    part = np.unique(texts, return_inverse=True)[1] % FOLDS  # copies are in one part
    for own in range(FOLDS):
        others = vectors[part != own] if (part != own).any() else vectors
        if not (part == own).any():
            continue
        centres, _ = cluster(others, k)
        for at in np.flatnonzero(part == own):
            for counts in map(ngram_counts, pieces_of(texts[at])):
                if counts is not None:
                    found[length_class(counts)].append(float((centres @ vector(counts, idf)).max()))
    least = min(LEAST_PIECES, max(map(len, found)))
    floors = [float(np.quantile(f, TAIL)) if len(f) >= least else None for f in found]
    last = next(f for f in floors if f is not None)
    for i, floor in enumerate(floors):
        last = floors[i] = last if floor is None else floor
    return np.array(floors)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS, held_out: int | None = 2, folds: int = 4) -> Centroids:
    """Learn from (doc_id, text, lang), rows of fold `held_out` left aside."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if held_out is not None:
        known = known.where(fold(F.col("doc_id"), folds) != held_out)
    ids = small_sample(known.select("doc_id", "lang"), F.col("doc_id"), per_language, "lang").select("doc_id").distinct()
    # At most per_language rows of each language: small enough to broadcast, and texts stay where they are.
    found = known.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
    sample = stored(small_sample(found, F.col("doc_id"), per_language, "lang").select("lang", "text"), "langid")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                counts = ngram_counts(text)
                if counts is not None:
                    seen += counts > 0
                    rows += 1
        yield pd.DataFrame({"rows": [rows], "seen": [seen]})

    parts = sample.mapInPandas(frequencies, "rows long, seen array<long>").collect()  # one row for each task
    rows = sum(p.rows for p in parts)
    seen = np.sum([np.asarray(p.seen) for p in parts], axis=0) if parts else np.zeros(DIMS)
    idf = np.log((1 + rows) / (1 + seen)) + 1

    def clusters(pages: pd.DataFrame) -> pd.DataFrame:
        counted = [(t, c) for t in sorted(pages["text"]) if (c := ngram_counts(t)) is not None]
        if not counted:
            return pd.DataFrame({"lang": [], "centre": [], "floors": []})
        vectors = np.stack([vector(c, idf) for _, c in counted])
        centres, own = cluster(vectors, k)
        floors = class_floors([t for t, _ in counted], vectors, idf, k).tolist()
        kept = [j for j in range(len(centres)) if (own == j).any()]
        return pd.DataFrame(
            {
                "lang": [pages["lang"].iloc[0]] * len(kept),
                "centre": [centres[j].tolist() for j in kept],
                "floors": [floors] * len(kept),
            }
        )

    # A group is a language's sample, which is bounded.
    learned = sample.groupBy("lang").applyInPandas(clusters, "lang string, centre array<float>, floors array<double>").collect()
    learned.sort(key=lambda row: row.lang)
    matrix = np.array([row.centre for row in learned], np.float32).reshape(len(learned), DIMS)
    floors = np.array([row.floors for row in learned]).reshape(len(learned), CLASSES)
    return Centroids(np.array([row.lang for row in learned]), matrix, floors, idf)


def predictor(docs: DataFrame, model: Centroids):
    """Column function of a text: struct of lang, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, accepted boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in texts:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang", "score", "accepted"])

    return predict


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every document."""
    found = scored(docs.select("doc_id", "text"), predictor(docs, model), F.col("text"))
    parts: list[Column] = [F.col(f"{ADDED}.{name}") for name in ("lang", "score", "accepted")]
    return found.select("doc_id", parts[0].alias("lang_pred"), parts[1], parts[2])


def keep_identified(docs: DataFrame, model: Centroids) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accepts() -> Callable[[str | None], bool]:
        own = shared.value
        return lambda text: bool(own.predict(text)[2])

    return kept(docs, accepts)
