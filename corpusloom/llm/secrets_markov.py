"""Secret scans: fixed patterns, then character Markov models.

Two first-order models over character classes, of random strings and of
ordinary identifiers, give every token the log-likelihood ratio of the two.
The labelled samples come from the corpus itself: the values that the fixed
patterns find are random strings, words without a digit that stand outside
them are ordinary; both are counted over all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import text_column, text_of

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns.  ASCII rules: letters of either case mean A-Z and a-z only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters or more; a shorter match holds no start of a longer one
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more, from its first character
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIN_VALUE = 8

#: a-z, A-Z and 0-9 stand for themselves, + / _ = - share a symbol; 63 is the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
STATES = 64
_CLASS = np.full(128, 62, dtype=np.int64)
_CLASS[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int, tuple[int, int]]]:
    """(start, kind, end, value span) of the fixed patterns, by start, then kind."""
    out = [(m.start(), 0, m.end(), m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.span()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.span()) for m in HEX.finditer(text)]
    return sorted(out)


def states(token: str) -> np.ndarray:
    return _CLASS[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]


def count_pairs(tokens: list[str]) -> np.ndarray:
    """STATES x STATES counts of neighbouring states; tokens start at state 63."""
    if not tokens:
        return np.zeros((STATES, STATES), np.int64)
    raw = np.frombuffer(("\x7f" + "\x7f".join(tokens)).encode("ascii"), dtype=np.uint8)
    s = np.where(raw == 127, STATES - 1, _CLASS[raw])
    keep = raw[1:] != 127
    return np.bincount(s[:-1][keep] * STATES + s[1:][keep], minlength=STATES * STATES).reshape(STATES, STATES)


WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_-]{6,}(?![A-Za-z0-9+/_=-])")


def labelled_tokens(text: str) -> tuple[list[str], list[str]]:
    """Values of the fixed patterns, and words outside them, of one text."""
    spans = base_spans(text)
    random = [text[a:b] for *_, (a, b) in spans]
    if not spans:
        return random, WORD.findall(text)
    masked, at = [], 0
    for start, _, end, _ in spans:
        masked.append(text[at : max(start, at)])
        at = max(at, end)
    masked.append(text[at:])
    return random, [w for part in masked for w in WORD.findall(part)]


def count_models(docs: DataFrame) -> DataFrame:
    """(kind, before, after, n): pair counts of random (1) and ordinary (0) tokens of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STATES, STATES), np.int64)
        for b in batches:
            for text in text_column(b):
                random, words = labelled_tokens(text)
                total[0] += count_pairs(words)
                if random:
                    total[1] += count_pairs([re.sub(r"[^A-Za-z0-9+/_=-]", "-", t) for t in random])
        kind, before, after = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (kind, before, after)] + [pa.array(total[kind, before, after])], ["kind", "before", "after", "n"])

    return docs.select("text").mapInArrow(run, "kind int, before int, after int, n long").groupBy("kind", "before", "after").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, prior: float = 0.5) -> np.ndarray:
    """STATES x STATES log-likelihood ratios, random over ordinary.

    Per million counts both models get ``prior`` for each pair, and a hundred
    for what the corpus may not show: the random one for every letter and digit,
    the ordinary one for pairs of one class (a-z, A-Z, 0-9) or with a mark, since
    identifiers of any language keep to a class for longer than random strings.
    """
    counts = np.zeros((2, STATES, STATES))
    for r in count_models(docs).collect():  # at most 2 x 64 x 64 rows
        counts[r.kind, r.before, r.after] = r.n
    for k in (0, 1):
        counts[k] = counts[k] / max(counts[k].sum(), 1.0) * 1e6
    counts[1, :, :62] += 100.0
    kind = np.repeat([0, 1, 2, 3], [26, 26, 10, 2])
    counts[0][(kind[:, None] == kind) | (kind[:, None] == 3) | (kind == 3)] += 100.0
    p = (counts + prior) / (counts + prior).sum(axis=2, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def token_score(ratio: np.ndarray, token: str) -> float:
    """Mean log-likelihood ratio of a character of the token."""
    s = np.concatenate(([STATES - 1], states(token)))
    return float(ratio[s[:-1], s[1:]].mean())


def looks_random(ratio: np.ndarray, token: str, threshold: float) -> bool:
    """Above the threshold, with a digit and a letter: words of a language that
    the samples lack have no digit, numbers and dates no letter."""
    return any(map(str.isdigit, token)) and any(map(str.isalpha, token)) and token_score(ratio, token) >= threshold


def scan(text: str, ratio: np.ndarray, threshold: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the fixed patterns, and of all spans: a token that
    looks random is added unless it overlaps one of the patterns' spans."""
    base = [(s, k, e) for s, k, e, _ in base_spans(text)]
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    extra = []
    for m in TOKEN.finditer(text):
        before = bisect_left(starts, m.end())  # spans that start before the token ends; does one reach into it?
        if not (before and reach[before - 1] > m.start()) and looks_random(ratio, m.group(), threshold):
            extra.append((m.start(), 3, m.end()))
    return base, sorted(base + extra)


def secrets(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, found): one row per row of ``docs``.

    ``found`` lists structs (kind, start, end, value) by start, then kind in the
    order of ``KINDS``; positions are code points, the end is exclusive.  Null
    and empty texts have an empty list; equal rows have equal lists.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # 64 x 64 numbers
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
    rows = docs.select("doc_id", text_of().alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("found", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for b in batches:
            found = []
            for text in text_column(b):
                found.append([{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for s, k, e in scan(text, ratio, threshold)[1]])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, type=kind)], ["doc_id", "found"])

    return rows.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from ``secrets``."""
    code = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("found", lambda x: x["kind"] != "random")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = F.array_join(F.transform(base, code), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text, 256).alias("base_sha256"), F.array_join(F.transform("found", code), ",").alias("spans"))
