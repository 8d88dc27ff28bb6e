"""Quality of a document from its lines: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of its own marks (symbols, capitals, digits, exclamation marks, words repeated at once, ...) and those of the
lines beside it; the chain adds how likely good and bad lines follow each other. Forward-backward gives each line's
marginal probability of being good; their mean, weighted by the lines' lengths, is the document's quality, which a
logistic curve maps to the probability of label 1.

The fit reads a bounded sample of labelled rows (`rows`, chosen by a hash of the id), of each at most `fit_lines` lines spread over the
text. Only documents are labelled, so a line starts with its document's label; the lines of bad documents that
look like those of good ones are then relabelled, but for the worst, and the chain is fitted to the result. Scoring reads every
line of every whole text.

Defined results: lines without a word count for nothing; a null or empty text, or one without a word, gets the score of
quality 0. Without labelled rows, or with one label only, every score is that label's share (0 if there is none).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.tables import ADDED, labelled_sample, scored

ROWS = 4_000
FIT_LINES = 48
STEPS = 120
RIDGE = 1.0
SYMBOLS = re.compile(r"[#*$%&|<>]")
CAPITALS = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
NAMES = ("symbols", "any_symbol", "shouts", "capitals", "digits", "echoes", "repeats", "seen", "length", "short")
OWN = len(NAMES)
WIDTH = 3 * OWN + 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH, characters of each) over the lines that hold a word: its own marks, then the neighbours', then 1."""
    own, sizes, before = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        symbols = len(SYMBOLS.findall(line))
        capitals = len(CAPITALS.findall(line))
        digits = sum(map(line.count, "0123456789"))
        echoes = sum(a == b for a, b in zip(words, words[1:]))
        own.append(
            (
                min(1.0, 4 * symbols / chars),
                float(symbols > 0.02 * chars),
                min(1.0, line.count("!") / n),
                capitals / chars,
                digits / chars,
                echoes / n,
                1 - len(set(words)) / n,
                float(hash(line) in before),
                min(1.0, np.log1p(n) / 8),
                float(n < 4),
            )
        )
        before.add(hash(line))
        sizes.append(chars)
    if not own:
        return np.zeros((0, WIDTH)), np.zeros(0)
    mine = np.array(own)
    edge = np.zeros((1, OWN))
    around = (mine, np.vstack((edge, mine[:-1])), np.vstack((mine[1:], edge)), np.ones((len(mine), 1)))
    return np.hstack(around), np.array(sizes, float)


def chain_marginals(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability that each line is good. score: log-odds of good by line; moves: 2 x 2 log weights (from, to), bad first.

    Forward-backward over the odds, in logs so that any number of lines is safe.
    """
    n = len(score)
    if not n:
        return np.zeros(0)
    ahead, back = [0.0] * n, [0.0] * n
    bb, bg, gb, gg = (float(x) for x in moves.reshape(-1))
    values = score.tolist()
    x = ahead[0] = values[0]
    for t in range(1, n):
        x = ahead[t] = values[t] + _log_ratio(x, bg, gg, bb, gb)
    y = 0.0
    for t in range(n - 2, -1, -1):
        y = back[t] = _log_ratio(y + values[t + 1], gb, gg, bb, bg)
    return 1 / (1 + np.exp(-np.clip(np.add(ahead, back), -40, 40)))


def _log_ratio(x: float, up0: float, up1: float, low0: float, low1: float) -> float:
    """log((e^up0 + e^(up1 + x)) / (e^low0 + e^(low1 + x)))."""
    return _add(up0, up1 + x) - _add(low0, low1 + x)


def _add(a: float, b: float) -> float:
    """log(e^a + e^b)."""
    return max(a, b) + log1p(exp(-abs(a - b)))


@dataclass
class LineField:
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float

    def quality(self, text: str | None) -> float:
        """Length-weighted mean of the lines' marginals."""
        found, sizes = line_features(text)
        if not len(sizes):
            return 0.0
        return float(chain_marginals(found @ self.weights, self.moves) @ sizes / sizes.sum())

    def score(self, text: str | None) -> float:
        return _curve(self.quality(text), self.slope, self.shift)


def _odds(quality):
    q = np.clip(quality, 0.001, 0.999)
    return np.log(q / (1 - q))


def _curve(quality: float, slope: float, shift: float) -> float:
    return float(1 / (1 + np.exp(-(slope * _odds(quality) + shift))))


def logistic(found: np.ndarray, label: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(found.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(found @ w, -30, 30)))
        grad = found.T @ (label - p) - ridge * w
        curve = (found * (p * (1 - p))[:, None]).T @ found + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(texts: list[np.ndarray], states: list[np.ndarray], steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of the chain by gradient ascent on the labelled lines, all texts at once."""
    n, longest = len(texts), max(map(len, texts))
    x = np.zeros((n, longest, WIDTH))
    y = np.zeros((n, longest), int)
    there = np.zeros((n, longest), bool)
    for i, (a, b) in enumerate(zip(texts, states)):
        x[i, : len(a)], y[i, : len(a)], there[i, : len(a)] = a, b, True
    lines = x[there]
    both = there[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    w = logistic(lines, y[there].astype(float), ridge)
    moves = np.zeros((2, 2))
    speed_w, speed_m = np.zeros(WIDTH), np.zeros((2, 2))
    scale_w, scale_m = np.full(WIDTH, 1e-8), np.full((2, 2), 1e-8)
    for step in range(1, steps + 1):
        score = x @ w
        node = np.stack((np.zeros_like(score), score), axis=2)
        ahead, back = node.copy(), np.zeros_like(node)
        for t in range(1, longest):
            reach = np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1])
            ahead[:, t] = np.where(there[:, t, None], node[:, t] + reach, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = node[:, t + 1] + back[:, t + 1]
            reach = np.logaddexp(after[:, :1] + moves[:, 0], after[:, 1:] + moves[:, 1])
            back[:, t] = np.where(there[:, t + 1, None], reach, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        good = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None])
        grad_w = np.einsum("nt,ntf->f", np.where(there, y - good, 0.0), x) - ridge * w
        pairs = ahead[:, :-1, :, None] + moves + (node + back)[:, 1:, None, :] - total[:, None, None, None]
        grad_m = seen - np.exp(pairs[both]).sum(axis=0) - ridge * moves
        # Adam
        speed_w, speed_m = 0.9 * speed_w + 0.1 * grad_w, 0.9 * speed_m + 0.1 * grad_m
        scale_w, scale_m = 0.99 * scale_w + 0.01 * grad_w**2, 0.99 * scale_m + 0.01 * grad_m**2
        small, fair = 1 - 0.9**step, 1 - 0.99**step
        w = w + 0.05 * (speed_w / small) / np.sqrt(scale_w / fair)
        moves = moves + 0.05 * (speed_m / small) / np.sqrt(scale_m / fair)
    return w, moves


def learn(found: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> LineField:
    """Fit to (features, sizes) of each text and its label."""
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.0
        return LineField(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    keep = [i for i, (a, _) in enumerate(found) if len(a)]
    texts, sizes, marks = [found[i][0] for i in keep], [found[i][1] for i in keep], label[keep].astype(int)
    if not keep or marks.min() == marks.max():
        return learn([], marks.astype(float))
    states = [np.full(len(a), m) for a, m in zip(texts, marks)]
    for _ in range(2):
        w = logistic(np.vstack(texts), np.concatenate(states).astype(float), ridge)
        for i, (a, m) in enumerate(zip(texts, marks)):
            if m == 0:
                odds = a @ w
                states[i] = (odds > 0).astype(int)
                states[i][int(np.argmin(odds))] = 0
    w, moves = fit_chain(texts, states, steps, ridge)
    quality = np.array([chain_marginals(a @ w, moves) @ s / s.sum() for a, s in zip(texts, sizes)])
    curve = logistic(np.column_stack((_odds(quality), np.ones(len(quality)))), marks.astype(float), 0.1)
    return LineField(w, moves, float(curve[0]), float(curve[1]))


def spread(found: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many lines, in runs from all over the text."""
    if len(sizes) <= most:
        return found, sizes
    at = np.unique(np.linspace(0, len(sizes) - 1, most).astype(int))
    return found[at], sizes[at]


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, fit_lines: int = FIT_LINES, folds: int = 5) -> LineField:
    """Learn from `labels.quality`; rows of fold 0 take no part."""

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [spread(*line_features(t), fit_lines) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "marks": [a.ravel() for a, _ in out], "sizes": [b for _, b in out]})

    sample = labelled_sample(docs, labels, "quality", rows, folds)
    found = sample.mapInPandas(featured, "label int, marks array<double>, sizes array<double>").toPandas()
    lines = [(np.asarray(m, float).reshape(-1, WIDTH), np.asarray(s, float)) for m, s in zip(found["marks"], found["sizes"])]
    return learn(lines, found["label"].to_numpy(float) if len(found) else np.zeros(0))


def score_quality(docs: DataFrame, model: LineField, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, quality (the mean marginal) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.quality(t) for t in batch], dtype="float64")

    found = scored(docs.select("doc_id", "text"), quality, F.col("text"))
    bounded = F.least(F.greatest(F.col(ADDED), F.lit(0.001)), F.lit(0.999))
    logit = F.log(bounded / (1 - bounded)) * model.slope + model.shift
    found = found.select("doc_id", F.col(ADDED).alias("quality"), (1 / (1 + F.exp(-logit))).alias("score"))
    return found.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "quality")
