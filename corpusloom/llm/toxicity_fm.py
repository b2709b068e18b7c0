"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings of four and five letters, so
inflected forms share evidence.  The terms that tell the classes apart best
enter a second-order factorization machine: beside its weight every term has a
vector, and the product of two vectors weighs the pair, such as an insult
beside the mention of a group.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Words, add_scores, collect_features, first_text, fold_of, labelled_sample, text_of, unique_pairs

BITS = 20
STARTS = (4, 5)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, id) of the terms of each text."""
    w = Words(texts)
    rows, keys = [w.row], [w.hashes(w.start, w.end)]
    for k in STARTS:
        long = w.end - w.start >= k
        s = w.start[long]
        rows.append(w.row[long]), keys.append(w.hashes(s, s + k) + np.uint64(k << 32))
    return unique_pairs(np.concatenate(rows), np.concatenate(keys) >> np.uint64(64 - BITS), BITS)


class Model(NamedTuple):
    place: np.ndarray  # by term: its row in linear and factors, or -1
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def select_terms(rows: list[np.ndarray], y: np.ndarray, terms: int) -> np.ndarray:
    """The terms with the largest log-likelihood ratio against the classes."""
    n = np.array([(y == k).sum() for k in (0, 1)], dtype=float)
    seen = np.stack([np.bincount(np.concatenate([r for r, c in zip(rows, y) if c == k] or [np.zeros(0, int)]), minlength=1 << BITS) for k in (0, 1)]).astype(float)
    both = seen.sum(axis=0)
    g = np.zeros(1 << BITS)
    for k in (0, 1):
        for part, expected in ((seen[k], both * n[k] / n.sum()), (n[k] - seen[k], (n.sum() - both) * n[k] / n.sum())):
            g += np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    best = np.argsort(-g, kind="stable")[:terms]
    return best[(g[best] > 8.0) & (both[best] >= 5)]  # weaker ones are chance among a million terms


def segment_sum(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *values.shape[1:]))
    np.add.at(out, row, values) if values.ndim > 1 else None
    return out if values.ndim > 1 else np.bincount(row, weights=values, minlength=n)


def raw_score(m: Model, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    v = m.factors[at]
    pairs = 0.5 * (segment_sum(v, row, n) ** 2 - segment_sum(v**2, row, n)).sum(axis=1)
    return m.bias + segment_sum(m.linear[at], row, n) + pairs


def fit(rows: list[np.ndarray], y: np.ndarray, prior: float, terms: int = 1024, rank: int = 8, rounds: int = 30, rate: float = 0.1, decay: float = 1e-3) -> Model | None:
    """Logistic loss by Adagrad over small batches; the bias is then moved from
    the odds of the sample to those of the labels.  None if a class is missing."""
    if len(set(y.tolist())) < 2:
        return None
    chosen = select_terms(rows, y, terms)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    rng = np.random.default_rng(11)
    m = Model(place, 0.0, np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), rank)))
    bias, seen = 0.0, [1e-6, np.full(len(chosen), 1e-6), np.full((len(chosen), rank), 1e-6)]
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            batch = order[lo : lo + 64]
            size = [len(rows[i]) for i in batch]
            row, at = np.repeat(np.arange(len(batch)), size), np.concatenate([rows[i] for i in batch])
            v = m.factors[at]
            total = segment_sum(v, row, len(batch))
            z = raw_score(m._replace(bias=bias), row, at, len(batch))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            used = np.unique(at)
            g1, g2 = np.zeros(len(chosen)), np.zeros((len(chosen), rank))
            np.add.at(g1, at, err[row])
            np.add.at(g2, at, err[row, None] * (total[row] - v))
            g1[used] += decay * m.linear[used] / len(batch)
            g2[used] += decay * m.factors[used] / len(batch)
            for k, (g, x) in enumerate(((g1, m.linear), (g2, m.factors)), 1):
                seen[k][used] += g[used] ** 2
                x[used] -= rate * g[used] / np.sqrt(seen[k][used])
            seen[0] += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(seen[0])
    p = y.mean()
    shift = np.log(prior / (1 - prior)) - np.log(p / (1 - p))
    return m._replace(bias=bias + shift, linear=m.linear.astype(np.float32), factors=m.factors.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 3000, folds: int = 5) -> Model | None:
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold_of("doc_id", folds) != 0)
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.5
    sample = first_text(docs, labelled_sample(labels, "toxic", rows_per_class, folds))
    rows, y, _ = collect_features(sample, features)
    return fit(rows, y, min(max(prior, 0.01), 0.99))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    The model sees at most ``rows_per_class`` labelled rows of each class, none
    of fold 0.  Null texts are empty texts and get the score of the bias; a null
    doc_id has the fold of an empty id.  Where the labels lack a class every
    score is 0.
    """
    model = train(docs, labels, folds=folds, **settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 places and at most `terms` vectors

    def make():
        m = shared.value

        def score(texts: list[str]) -> np.ndarray:
            if m is None:
                return np.zeros(len(texts))
            row, ids = features(texts)
            at = m.place[ids]
            z = raw_score(m, row[at >= 0], at[at >= 0], len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score

    rows = docs.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), text_of().alias("text"))
    return add_scores(rows, make, "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
