"""Language ID by a linear-chain conditional random field over words.

A word has weights for its n-grams of one to four characters, the word's ends
included (so prefixes and suffixes are among them), for the word itself and for
the lexicons it stands in; neighbouring words are tied by learned transitions.
Forward-backward gives each word the probability of every language, also where
a text switches between languages; a document gets the language with the
largest mean over its words.

Chains are whole texts.  They are cut into blocks only to be worked on side by
side: products of each block's transfer matrices carry the chain across blocks,
so the result is that of the uncut chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.scale import top_k
from corpusloom.llm.common import Words, fold_of, mix64, pieces, stored, text_column, text_key, text_of

BITS = 16
BLOCK = 64


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # feature x label
    transitions: np.ndarray  # label before x label
    lexicon: np.ndarray  # sorted word hashes
    lexicon_of: np.ndarray  # their label


def word_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature id) of all n-grams of all words, and of the words."""
    size = w.end - w.start
    # the words one after another, each between two marks
    total = size + 2
    first = np.cumsum(total) - total
    chars = np.zeros(int(total.sum()), dtype=np.uint64)
    word = np.repeat(np.arange(len(size)), total)
    inner = np.arange(len(chars)) - np.repeat(first, total)
    body = (inner > 0) & (inner < np.repeat(total, total) - 1)
    chars[body] = w.points[np.repeat(w.start, size) + inner[body] - 1].astype(np.uint64) + np.uint64(1)
    words, ids = [], []
    for k in (1, 2, 3, 4):
        n = len(chars) - k + 1
        if n <= 0:
            break
        h = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + chars[i : i + n]
        whole = word[:n] == word[k - 1 :]
        words.append(word[:n][whole]), ids.append(mix64(h[whole]) >> np.uint64(64 - BITS))
    words.append(np.arange(len(size))), ids.append(w.hashes(w.start, w.end) >> np.uint64(64 - BITS))
    return np.concatenate(words), np.concatenate(ids).astype(np.int64)


def distinct_words(w: Words) -> tuple[np.ndarray, Words, np.ndarray]:
    """Hashes of the different words, the words themselves, and which of them each word is."""
    kinds, at, back = np.unique(w.hashes(w.start, w.end), return_index=True, return_inverse=True)
    few = object.__new__(Words)
    few.points, few.start, few.end, few._sums, few._back = w.points, w.start[at], w.end[at], w._sums, w._back
    return kinds, few, back


def emissions(m: Model, w: Words) -> np.ndarray:
    """word x label scores; each different word of the range is worked out once."""
    kinds, few, back = distinct_words(w)
    word, ids = word_features(few)
    out = np.stack([np.bincount(word, weights=m.weights[ids, k], minlength=len(kinds)) for k in range(len(m.labels))], axis=1)
    if len(m.lexicon):
        place = np.minimum(np.searchsorted(m.lexicon, kinds), len(m.lexicon) - 1)
        known = np.flatnonzero(m.lexicon[place] == kinds)
        of = m.lexicon_of[place[known]]
        out[known] += m.weights[(1 << BITS) + of]
    return out[back]


def marginals(emit: np.ndarray, transitions: np.ndarray, row: np.ndarray) -> np.ndarray:
    """word x label probabilities; ``row`` tells (in order) the chain of each word."""
    return forward_backward(emit, transitions, row)[0]


def forward_backward(emit: np.ndarray, transitions: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals, and how often each label is expected after each; the first
    word of a chain follows an unknown label."""
    n, labels = emit.shape
    pairs = np.zeros((labels, labels))
    if not n:
        return emit, pairs
    step = np.exp(transitions - transitions.max())
    local = np.exp(emit - emit.max(axis=1, keepdims=True)) + 1e-30
    first = np.flatnonzero(np.diff(np.concatenate(([-1], row))))  # of each chain
    length = np.diff(np.concatenate((first, [n])))
    blocks = -(-length // BLOCK)
    chain = np.repeat(np.arange(len(first)), blocks)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[chain] + number * BLOCK
    size = np.minimum(length[chain] - number * BLOCK, BLOCK)
    grid = np.minimum(begin[:, None] + np.arange(BLOCK), n - 1)
    real = np.arange(BLOCK) < size[:, None]
    e = np.where(real[:, :, None], local[grid], 1.0)
    # transfer matrix of each block, and its state-to-state products carried over the blocks of a chain
    m = np.broadcast_to(np.eye(labels), (len(chain), labels, labels)).copy()
    for t in range(BLOCK):
        if not real[:, t].any():
            break
        on = real[:, t]
        nxt = (m[on] @ step) * e[on, t][:, None, :]
        m[on] = nxt / nxt.sum(axis=(1, 2), keepdims=True)
    alpha0 = np.full((len(chain), labels), 1.0 / labels)  # before the block, one transition away
    beta0 = np.ones((len(chain), labels))  # after the block
    for b in range(1, int(blocks.max(initial=1))):
        at = np.flatnonzero(number == b)
        v = np.einsum("bi,bij->bj", alpha0[at - 1], m[at - 1])
        alpha0[at] = v / v.sum(axis=1, keepdims=True)
    last = blocks[chain] - 1 - number
    for b in range(1, int(blocks.max(initial=1))):
        at = np.flatnonzero(last == b)
        v = np.einsum("bij,bj->bi", m[at + 1], beta0[at + 1])
        beta0[at] = v / v.sum(axis=1, keepdims=True)
    forward = np.empty((len(chain), BLOCK, labels))
    a = alpha0
    for t in range(BLOCK):
        new = (a @ step) * e[:, t]
        a = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), a)
        forward[:, t] = a
    out = np.empty((n, labels))
    b = beta0
    for t in range(BLOCK - 1, -1, -1):
        p = forward[:, t] * b
        on = real[:, t]
        out[grid[on, t]] = (p / p.sum(axis=1, keepdims=True))[on]
        after = e[:, t] * b
        before = forward[:, t - 1] if t else alpha0
        weight = 1.0 / np.einsum("bi,ij,bj->b", before[on], step, after[on])
        pairs += step * ((before[on] * weight[:, None]).T @ after[on])
        new = after @ step.T
        b = np.where(on[:, None], new / new.sum(axis=1, keepdims=True), b)
    return out, pairs


def train_sequences(row: np.ndarray, y: np.ndarray, span: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and chains: spans of up to ``span`` words, joined in random
    order by fours, so that chains keep and change language as code-switched
    text does.  ``row`` is the text of each word."""
    number = np.arange(len(row)) - np.searchsorted(row, row)
    piece = np.cumsum(np.concatenate(([0], (np.diff(row) != 0) | (number[1:] % span == 0))))
    count = int(piece[-1]) + 1 if len(piece) else 0
    order = rng.permutation(count)
    # half of the joints stay inside a language
    label = y[row[np.searchsorted(piece, order)]] if count else order
    half = count // 2
    order[:half] = order[:half][np.argsort(label[:half], kind="stable")]
    bounds = np.searchsorted(piece, np.arange(count + 1))
    words = np.concatenate([np.arange(bounds[p], bounds[p + 1]) for p in order]) if count else np.zeros(0, np.int64)
    chain = np.repeat(np.arange(count) // 4, bounds[order + 1] - bounds[order]) if count else words
    return words, chain


class Sample(NamedTuple):
    row: np.ndarray  # the text of each word
    kind: np.ndarray  # which different word each is
    kinds: np.ndarray  # hashes of the different words, sorted
    cut: np.ndarray  # their features are ids[cut[i]:cut[i + 1]]
    ids: np.ndarray


def read_sample(texts: list[str]) -> Sample:
    """Features of every different word, made piece by piece; the pieces' own arrays do not stay."""
    rows, keys = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    kinds, sizes, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    known = np.zeros(0, np.uint64)
    for lo, hi in pieces(texts):
        w = Words(texts[lo:hi])
        here, few, back = distinct_words(w)
        rows.append((w.row + lo).astype(np.int32))
        keys.append(here[back])
        fresh = np.flatnonzero(~np.isin(here, known))
        few.start, few.end = few.start[fresh], few.end[fresh]
        word, of = word_features(few)
        order = np.argsort(word, kind="stable")
        kinds.append(here[fresh])
        sizes.append(np.bincount(word, minlength=len(fresh)))
        ids.append(of[order].astype(np.int32))
        known = np.union1d(known, here)
    kinds, size, ids = np.concatenate(kinds), np.concatenate(sizes), np.concatenate(ids)
    order = np.argsort(kinds)
    start = (np.cumsum(size) - size)[order]
    size = size[order]
    cut = np.concatenate(([0], np.cumsum(size)))
    ids = ids[np.repeat(start - cut[:-1], size) + np.arange(cut[-1])]
    return Sample(np.concatenate(rows), np.searchsorted(kinds[order], np.concatenate(keys)).astype(np.int32), kinds[order], cut, ids)


def lexicons(s: Sample, of_word: np.ndarray, labels: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and labels: of each language the most frequent words of
    which at least four fifths stand in its texts."""
    total = np.bincount(s.kind, minlength=len(s.kinds))
    lex, lex_of = [], []
    for k in range(labels):
        count = np.bincount(s.kind[of_word == k], minlength=len(s.kinds))
        best = np.argsort(-count, kind="stable")[:most]
        best = best[(count[best] >= 0.8 * total[best]) & (count[best] >= 3)]
        lex.append(s.kinds[best]), lex_of.append(np.full(len(best), k))
    lex, lex_of = np.concatenate(lex), np.concatenate(lex_of)
    at = np.argsort(lex)
    return lex[at], lex_of[at]


def pair_gradient(pairs: np.ndarray, transitions: np.ndarray, y: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Expected label pairs less those of the labels ``y``; before the first
    word of a chain stands an unknown label, spread as the transitions say."""
    seen = np.zeros_like(pairs)
    first = np.concatenate(([True], np.diff(chain) != 0))
    np.add.at(seen, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1.0)
    step = np.exp(transitions - transitions.max())
    seen += step / step.sum(axis=0) * np.bincount(y[first], minlength=len(pairs))
    return pairs - seen


def fit(texts: list[str], y: np.ndarray, labels: list[str], lexicon_words: int = 500, rounds: int = 6, span: int = 12) -> Model:
    """Adagrad on the log likelihood: the gradient of a word is its marginal less
    its label, that of the transitions the expected label pairs less the given."""
    s = read_sample(texts)
    of_word = y[s.row]
    lex, lex_of = lexicons(s, of_word, len(labels), lexicon_words)
    m = Model(labels, np.zeros(((1 << BITS) + len(labels), len(labels)), np.float32), np.zeros((len(labels), len(labels))), lex, lex_of)
    place = np.minimum(np.searchsorted(lex, s.kinds), max(len(lex) - 1, 0))
    in_lex = lex[place] == s.kinds if len(lex) else np.zeros(len(s.kinds), bool)
    rng = np.random.default_rng(5)
    g_w, g_t = np.full_like(m.weights, 1e-4), np.full_like(m.transitions, 1e-4)
    for _ in range(rounds):
        seq, chain = train_sequences(s.row, y, span, rng)
        edges = np.searchsorted(chain, np.arange(0, int(chain.max(initial=0)) + 33, 32))
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = seq[lo:hi]
            if not len(own):
                continue
            kind = s.kind[own]
            size = s.cut[kind + 1] - s.cut[kind]
            flat = np.repeat(s.cut[kind] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            of = np.repeat(np.arange(len(own)), size)
            f = s.ids[flat]
            known = np.flatnonzero(in_lex[kind])
            of = np.concatenate((of, known))
            f = np.concatenate((f, (1 << BITS) + lex_of[place[kind[known]]]))
            emit = np.stack([np.bincount(of, weights=m.weights[f, k], minlength=len(own)) for k in range(len(labels))], axis=1)
            p, pairs = forward_backward(emit, m.transitions, chain[lo:hi])
            err = p.copy()
            err[np.arange(len(own)), of_word[own]] -= 1.0
            used, f_at = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(f_at, weights=err[of, k], minlength=len(used)) for k in range(len(labels))], axis=1) / 32 + 1e-4 * m.weights[used]
            g_w[used] += grad**2
            m.weights[used] -= 0.1 * grad / np.sqrt(g_w[used])
            grad = pair_gradient(pairs, m.transitions, of_word[own], chain[lo:hi]) / 32
            g_t += grad**2
            m.transitions[...] -= 0.1 * grad / np.sqrt(g_t)
    return m


def train(docs: DataFrame, rows_per_label: int = 400, folds: int = 4, held: int = 2, most_chars: int = 20_000) -> Model | None:
    """Learns every language that has training rows, each from at most
    ``rows_per_label`` whole texts.  Texts of up to ``most_chars`` code points go
    first, in hash order; a language with fewer of them learns from a stretch of
    that length at a hashed place of longer ones.  None without rows."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(fold_of("doc_id", folds) != held)
    rows = rows.select("lang", "text", F.xxhash64("doc_id", text_key()).alias("key"), (F.length("text") > most_chars).alias("long"))
    chosen = top_k(rows.select("lang", "long", "key").distinct(), ["lang"], ["long", "key"], rows_per_label)
    chosen = stored(chosen, "sample-keys")  # of known size: texts are not shuffled unless there are very many languages
    place = F.pmod("key", F.greatest(F.length("text") - most_chars, F.lit(0)) + 1).cast("int")
    sample = rows.join(chosen, ["lang", "long", "key"]).withColumn("text", F.substring("text", place + 1, F.lit(most_chars)))
    sample = sample.dropDuplicates(["lang", "key"]).orderBy("key", "lang").select("lang", "text").collect()
    labels = sorted({r.lang for r in sample})
    if not labels:
        return None
    number = {x: i for i, x in enumerate(labels)}
    return fit([r.text for r in sample], np.array([number[r.lang] for r in sample]), labels)


def label_words(m: Model, text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, language, probability) of every word of a text, in code points."""
    w = Words([text])
    if not len(w.start):
        return []
    p = marginals(emissions(m, w), m.transitions, w.row)
    best = p.argmax(axis=1)
    return [(int(s), int(e), m.labels[k], float(x)) for s, e, k, x in zip(w.start, w.end, best, p[np.arange(len(p)), best])]


def languages(docs: DataFrame, folds: int = 4, held: int = 2, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``.

    ``score`` is the mean probability of the predicted language over the words.
    A null text or one without a letter is ``und`` with score 0, as is any text
    if no row could be learned from; ties go to the language first in code
    point order; a null doc_id has the fold of an empty id.
    """
    model = train(docs, folds=folds, held=held, **settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 rows of floats and the lexicons
    rows = docs.select("doc_id", (fold_of("doc_id", folds) == held).alias("held_out"), text_of().alias("text"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = text_column(b)
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            for lo, hi in pieces(texts):
                w = Words(texts[lo:hi])
                if m is None or not len(w.start):
                    continue
                p = marginals(emissions(m, w), m.transitions, w.row)
                mass = np.stack([np.bincount(w.row, weights=p[:, k], minlength=hi - lo) for k in range(len(m.labels))], axis=1)
                words = np.bincount(w.row, minlength=hi - lo)
                for i in np.flatnonzero(words):
                    k = int(mass[i].argmax())
                    pred[lo + i], score[lo + i] = m.labels[k], min(mass[i, k] / words[i], 1.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred), pa.array(score)], schema.names)

    return rows.mapInArrow(run, schema)
