"""Toxicity of a text: a sparse linear classifier, regularised by counterfactuals.

A text's features are the words it holds, and their beginnings of three to eight letters, each counted once. The
weights are logistic with an L1 penalty, so words that only happened to stand in a toxic text get none and a long text gathers
no noise. The counterfactual term looks at sentences of the labelled documents that name a group of people: the name is
swapped for another of its kind, and the squared change of the sentence's score is penalised. A group's name thus cannot carry
toxicity of its own, and a neutral mention of it is not one.

The fit reads a bounded sample of labelled rows (`rows`, chosen by a hash of the id). Features are counted and screened in Spark; what
is left of the sample is solved on the driver. Scoring reads every whole text.

Defined results: null and empty texts get the score of a text without features. Without labelled rows, or with one label only,
every score is that label's share (0 if there is none). Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.tables import ADDED, kept, labelled_sample, scored, stored

ROWS = 12_000
SPACE = (1 << 40) - 1
LEAST_DOCS = 3
LEAST_Z = 4.0
L1 = 0.1
#: Lengths of the word beginnings that are features.
STEMS = (3, 4, 5, 6, 7, 8)
COUNTERFACTUAL = 5.0
STEPS = 150
CACHE_WORDS = 500_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

#: Names of groups of people, by kind; within a kind they may be swapped.
GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "native"),
    ("woman", "man", "girl", "boy", "transgender", "nonbinary"),
    ("women", "men", "girls", "boys"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "polish", "turkish", "nigerian"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
)


def features_of(word: str) -> list[int]:
    """Hashed features of a lowered word: itself, and its beginnings."""
    parts = [word] + [word[:n] + "*" for n in STEMS if len(word) > n]
    return [xxhash.xxh3_64_intdigest(p) & SPACE for p in parts]


def text_features(text: str | None) -> np.ndarray:
    found = {f for word in set(WORD.findall((text or "").lower())) for f in features_of(word)}
    return np.fromiter(found, np.int64, len(found))


def swap_map(groups=GROUPS) -> dict[str, str]:
    """Each name's partner: the next of its kind."""
    return {name: kind[(i + 1) % len(kind)] for kind in groups for i, name in enumerate(kind)}


def swapped_pairs(text: str | None, swaps: dict[str, str]) -> list[tuple[str, str]]:
    """(name, partner) of every sentence's group names; the rest of the sentence cancels out of the change of its score."""
    low = (text or "").lower()
    return [(w, swaps[w]) for sentence in SENTENCE.findall(low) for w in set(WORD.findall(sentence)) & swaps.keys()]


@dataclass
class Classifier:
    bias: float
    weights: dict[int, float]  # of the features that have one
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        seen: set[int] = set()
        cache, weights = self.cache, self.weights
        for word in set(WORD.findall((text or "").lower())):
            known = cache.get(word)
            if known is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                known = cache[word] = tuple(f for f in features_of(word) if f in weights)
            if known:
                seen.update(known)
        logit = self.bias + sum(weights[f] for f in sorted(seen))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def solve(
    flat: np.ndarray, row: np.ndarray, label: np.ndarray, columns: int, pairs: np.ndarray, l1: float, counterfactual: float, steps: int
) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient over rows of features that are present (`flat`, by `row`).

    pairs: (plus, minus, times) columns of each swap; -1 for a feature that has no weight.
    """
    rows = len(label)
    # A separable bound of the curvature: each column's rows, weighted by how many columns they hold (the bias is one).
    width = np.bincount(row, minlength=rows) + 1.0
    lip = 0.25 * np.bincount(flat, weights=width[row], minlength=columns) + 1e-9
    lip_b = 0.25 * width.sum()
    plus, minus, times = pairs
    for side in (plus, minus):
        real = side >= 0
        lip += 2 * counterfactual * np.bincount(side[real], weights=times[real], minlength=columns)
    w, b = np.zeros(columns), float(np.log((label.sum() + 0.5) / (rows - label.sum() + 0.5)))
    z, zb, t = w.copy(), b, 1.0
    padded = np.zeros(columns + 1)
    for _ in range(steps):
        logit = zb + np.bincount(row, weights=z[flat], minlength=rows)
        slack = 1 / (1 + np.exp(-logit)) - label
        grad = np.bincount(flat, weights=slack[row], minlength=columns)
        if len(plus):
            padded[:-1] = z
            change = counterfactual * times * (padded[plus] - padded[minus])
            turned = np.bincount(np.where(plus < 0, columns, plus), weights=change, minlength=columns + 1)
            turned -= np.bincount(np.where(minus < 0, columns, minus), weights=change, minlength=columns + 1)
            grad += turned[:-1]
        new = z - grad / lip
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / lip, 0)
        new_b = zb - slack.sum() / lip_b
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        step = (t - 1) / t_next
        z, zb, w, b, t = new + step * (new - w), new_b + step * (new_b - b), new, new_b, t_next
    return b, w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = ROWS,
    groups=GROUPS,
    l1: float = L1,
    counterfactual: float = COUNTERFACTUAL,
    folds: int = 5,
) -> Classifier:
    """Learn from `labels.toxic`; rows of fold 0 take no part."""
    swaps = swap_map(groups)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [swapped_pairs(t, swaps) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "label": batch["label"],
                    "features": [text_features(t) for t in batch["text"]],
                    "names": [[p[0] for p in own] for own in pairs],
                }
            )

    sample = labelled_sample(docs, labels, "toxic", rows, folds)
    found = stored(sample.mapInPandas(featured, "label int, features array<long>, names array<string>"), "toxicity")
    total, toxic = found.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total or toxic in (0, total):
        share = toxic / total if total else 0.0
        return Classifier(float(np.log((share + 1e-9) / (1 - share + 1e-9))), {})
    # Features whose share of toxic rows is what chance would give can't matter; without them the rest converge fast.
    mean = toxic / total
    seen = found.select("label", F.explode("features").alias("feature")).groupBy("feature")
    seen = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_toxic")).where(F.col("n") >= LEAST_DOCS)
    excess = F.abs(F.col("n_toxic") - F.col("n") * mean)
    telling = seen.where(excess >= LEAST_Z * F.sqrt(F.col("n") * mean * (1 - mean))).select("feature").toPandas()
    kept = np.sort(telling["feature"].to_numpy(np.int64))

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.searchsorted(kept, np.intersect1d(f, kept)) for f in batch["features"]]
            yield pd.DataFrame({"label": batch["label"], "columns": own, "names": batch["names"]})

    marks = found.mapInPandas(reduced, "label int, columns array<int>, names array<string>").toPandas()
    label = marks["label"].to_numpy(float)
    sizes = marks["columns"].map(len).to_numpy()
    flat = np.concatenate(marks["columns"].map(np.asarray).to_list()).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = {int(f): i for i, f in enumerate(kept)}
    names, times = np.unique(np.concatenate(marks["names"].map(np.asarray).to_list()).astype(str), return_counts=True)
    changes = []
    for name, n in zip(names, times):
        own, other = set(features_of(name)), set(features_of(swaps[name]))
        # The change of a sentence's score is a sum; each of its parts is held down.
        whole = (features_of(name)[0], features_of(swaps[name])[0])
        changes += [(at.get(whole[1], -1), at.get(whole[0], -1), n)]
        changes += [(-1, at[f], n) for f in own - other if f in at and f != whole[0]]
        changes += [(at[f], -1, n) for f in other - own if f in at and f != whole[1]]
    pairs = np.array(changes, np.int64).reshape(-1, 3).T
    b, w = solve(flat, row, label, len(kept), pairs, l1, counterfactual, STEPS)
    return Classifier(b, {int(f): float(x) for f, x in zip(kept, w) if x})


def scorer(docs: DataFrame, model: Classifier):
    """Column function of a text: its toxicity from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Classifier(*shared.value)
        for batch in texts:
            yield pd.Series([own.score(t) for t in batch], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, model: Classifier, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of every document."""
    found = scored(docs.select("doc_id", "text"), scorer(docs, model), F.col("text"))
    return found.select("doc_id", F.col(ADDED).alias("score"), (F.col(ADDED) >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Classifier, threshold: float = 0.5) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def accepts() -> Callable[[str | None], bool]:
        own = Classifier(*shared.value)
        return lambda text: own.score(text) < threshold

    return kept(docs, accepts)
