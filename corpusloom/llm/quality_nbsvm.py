"""Quality classifier: naive Bayes support vectors over character n-grams.

Indicators of hashed n-grams are scaled by the log ratio of their class counts
and the row is brought to length one; a linear model with hinge loss is fitted
by dual coordinate descent, and margins become probabilities by a logistic
curve fitted on sample rows that the fit has not seen.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import add_scores, code_points, collect_features, first_text, fold_of, labelled_sample, letter_tables, mix64, text_of, unique_pairs

BITS = 18
SIZES = (1, 3)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) by row, distinct within a size: n-grams of 1 and 3 characters (digits alike,
    white space alike), and in coarse steps the length, how often a 3-gram comes
    back on average, and both together, which tell texts that repeat themselves."""
    points, n = code_points(texts)
    letter, _ = letter_tables()
    p = np.where((points < 33), 32, np.where((points > 47) & (points < 58), 48, points)).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
    rows, ids = [np.arange(len(texts))], [np.zeros(len(texts), np.uint64)]  # id 0: every text, empty ones too
    for k in SIZES:
        h = np.full(max(len(p) - k + 1, 0), k, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + p[i : len(p) - k + 1 + i]
        whole = at[k - 1 :] >= k - 1
        r, i = unique_pairs(row[k - 1 :][whole], mix64(h[whole]) >> np.uint64(64 - BITS), BITS)
        rows.append(r), ids.append(i.astype(np.uint64))
    kinds = np.bincount(rows[-1], minlength=len(texts))
    size, repeats = np.log2(n + 1).astype(np.int64), (2 * np.log2((n + 1) / (kinds + 1))).astype(np.int64)
    for shape in (size, repeats + (1 << 8), (size << 8) + repeats + (1 << 16)):
        rows.append(np.arange(len(texts))), ids.append(mix64(shape.astype(np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - BITS))
    row, ids = np.concatenate(rows), np.concatenate(ids).astype(np.int64)
    order = np.argsort(row, kind="stable")
    return row[order], ids[order]


class Model(NamedTuple):
    weight: np.ndarray  # ratio times weight, by feature
    square: np.ndarray  # squared ratio, by feature
    slope: float
    shift: float


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of (share of class 1 counts / share of class 0 counts), smoothed by one."""
    counts = [np.bincount(np.concatenate([r for r, c in zip(rows, y) if c == k]), minlength=1 << BITS) + 1.0 for k in (0, 1)]
    return (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of least 0.5 |w|^2 + cost * sum(max(0, 1 - y w.x)), rows of length one."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slack = 1.0 - y[i] * (w[rows[i]] @ values[i])
            new = min(max(alpha[i] + slack, 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of p = 1 / (1 + exp(-(slope m + shift))) by Newton steps, lightly damped."""
    a, b = 1.0, 0.0
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y == 1, hi, lo)
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        grad = x @ (p - t) + 1e-3 * np.array([a, b])
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model | None:
    """None if the sample lacks a class."""
    train = np.arange(len(rows)) % 5 != 0
    if any((y[part] == k).sum() == 0 for part in (train, ~train) for k in (0, 1)):
        return None
    ratio = ratios([r for r, t in zip(rows, train) if t], y[train])
    scaled = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-9) for r in rows]
    own = [i for i in np.flatnonzero(train)]
    w = dual_descent([rows[i] for i in own], [scaled[i] for i in own], np.where(y[own] == 1, 1.0, -1.0), 1 << BITS)
    rest = np.flatnonzero(~train)
    margin = np.array([w[rows[i]] @ scaled[i] for i in rest])
    return Model((w * ratio).astype(np.float32), ratio**2, *logistic_curve(margin, y[rest]))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2500, folds: int = 5) -> Model | None:
    sample = first_text(docs, labelled_sample(labels, "quality", rows_per_class, folds))
    rows, y, _ = collect_features(sample, features)
    return fit(rows, y)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    The model sees at most ``rows_per_class`` labelled rows of each class, none
    of fold 0.  Null texts are empty texts and get a score; a null doc_id has
    the fold of an empty id.  Where the labels lack a class every score is 0.5.
    """
    model = train(docs, labels, folds=folds, **settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2**18 floats

    def make():
        m = shared.value

        def score(texts: list[str]) -> np.ndarray:
            if m is None:
                return np.full(len(texts), 0.5)
            row, ids = features(texts)
            dot = np.bincount(row, weights=m.weight[ids], minlength=len(texts))
            length = np.sqrt(np.maximum(np.bincount(row, weights=m.square[ids], minlength=len(texts)), 1e-18))
            return 1 / (1 + np.exp(-np.clip(m.slope * dot / length + m.shift, -30, 30)))

        return score

    rows = docs.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), text_of().alias("text"))
    return add_scores(rows, make, "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
