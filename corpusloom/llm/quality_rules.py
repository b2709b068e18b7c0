"""Quality rules with n-gram perplexity bands.

A modified Kneser-Ney model over characters, one per language, is counted by
Spark over the whole corpus: tasks pre-aggregate the n-grams of highest order,
and lower orders, discounts and interpolated probabilities are derived from
their table.  No n-gram is cut.  Scoring tasks search sorted arrays of packed
n-grams, or a join does it where the model is large.  A document is rejected if it fails the base rules or if its
perplexity leaves the band of its language.

Symbols take 10 bits: code points below 768 stand for themselves, others share
254 symbols; all digits are one symbol and all white space is a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import code_points, pieces, stored, text_column, text_key

ORDER = 5
SYMBOL_BITS = 10
LANGUAGES = 1022
BASE = {"n_words": 0, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0}
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() parts at space and 09-0D
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    n = len(number)
    if n == len(words):
        return 0
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    _, kind, count = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = count[kind] > 1
    marked = np.zeros(len(words), dtype=bool)
    for k in range(3):
        marked[k : len(words) - 2 + k] |= twice
    return int(marked.sum())


def _symbol_table() -> np.ndarray:
    c = np.arange(0x110000)
    table = np.where(c < 768, c, 768 + c % 254)
    table[ord("0") : ord("9") + 1] = ord("0")
    for s in SPACES:
        table[ord(s)] = 32
    table[0] = 1  # 0 stands for what is before the text
    return table.astype(np.uint16)


class Packer:
    """Texts to packed n-grams of highest order, language number in front."""

    def __init__(self):
        self.table = _symbol_table()

    def __call__(self, texts: list[str], lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, n = code_points(texts)
        sym = self.table[points].astype(np.uint64)
        at = np.arange(len(sym)) - np.repeat(np.cumsum(n) - n, n)
        grams = np.repeat(lang.astype(np.uint64) << np.uint64(SYMBOL_BITS * ORDER), n) | sym
        for k in range(1, ORDER):
            before = sym[:-k] * (at[k:] >= k)
            grams[k:] |= before << np.uint64(SYMBOL_BITS * k)
        return grams, n


def language_numbers(docs: DataFrame) -> dict[str, int]:
    """The languages with most documents get numbers from 1; null and all others share 0."""
    top = docs.filter("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    return {r.lang: i for i, r in enumerate(top, 1)}


def _numbers(column, langs: dict[str, int]) -> np.ndarray:
    return np.fromiter((langs.get(x, 0) for x in column.to_pylist()), dtype=np.int64, count=len(column))


def count_grams(docs: DataFrame, langs: dict[str, int], held: int = 1 << 21) -> DataFrame:
    """(lang, g, c): n-grams of highest order over whole texts of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, parts, size = Packer(), [], 0

        def emit():
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            c = np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)
            lang, g = keys >> np.uint64(SYMBOL_BITS * ORDER), keys & np.uint64((1 << SYMBOL_BITS * ORDER) - 1)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (lang, g, c)], ["lang", "g", "c"])

        for b in batches:
            texts, lang = text_column(b), _numbers(b.column("lang"), langs)
            for lo, hi in pieces(texts):
                keys, c = np.unique(pack(texts[lo:hi], lang[lo:hi])[0], return_counts=True)
                parts.append((keys, c))
                size += len(keys)
                if size > held:
                    yield emit()
                    parts, size = [], 0
        if parts:
            yield emit()

    found = docs.select("lang", "text").mapInArrow(run, "lang long, g long, c long")
    return found.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _discount(c: Column) -> Column:
    return F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def _with_discounts(grams: DataFrame) -> DataFrame:
    """Adds d1, d2, d3 of the language: the usual estimates from the counts of
    counts, kept within 0.05 and the count where counts are too few."""
    of = lambda k: F.sum((F.col("c") == k).cast("double"))
    n = grams.groupBy("lang").agg(*[of(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    est = [F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5 * k)) for k in (1, 2, 3)]
    d = n.select("lang", *[F.least(F.greatest(e, F.lit(0.05)), F.lit(0.95 * k)).alias(f"d{k}") for k, e in enumerate(est, 1)])
    return grams.join(d, "lang")


def estimate(grams: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For order 1 to ``ORDER``: (lang, g, p) of all n-grams and the back-off
    weights (lang, h, gamma) of their contexts."""
    tables = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("g").bitwiseAND((1 << SYMBOL_BITS * n) - 1)
        tables[n] = stored(tables[n + 1].groupBy("lang", suffix.alias("g")).agg(F.count(F.lit(1)).alias("c")), f"grams{n}")
    out, lower = [], None
    for n in range(1, ORDER + 1):
        g = _with_discounts(tables[n]).withColumn("h", F.shiftright("g", SYMBOL_BITS))
        mass = F.sum(_discount(F.col("c"))) / F.sum("c")
        contexts = g.groupBy("lang", "h").agg(F.sum("c").alias("total"), mass.alias("gamma"))
        g = g.join(contexts, ["lang", "h"])
        own = (F.col("c") - _discount(F.col("c"))) / F.col("total")
        if lower is None:
            p = own + F.col("gamma") / (1 << SYMBOL_BITS)
        else:
            rest = F.col("g").bitwiseAND((1 << SYMBOL_BITS * (n - 1)) - 1)
            g = g.withColumn("r", rest).join(lower.select("lang", F.col("g").alias("r"), F.col("p").alias("q")), ["lang", "r"])
            p = own + F.col("gamma") * F.col("q")
        lower = stored(g.select("lang", "g", "h", "c", "gamma", p.alias("p")), f"probabilities{n}")
        out.append((lower.select("lang", "g", "p"), lower.select("lang", F.col("h").alias("g"), F.col("gamma").alias("p")).distinct()))
    return out


class Model(NamedTuple):
    """Per order: sorted packed n-grams with log p, sorted contexts with log gamma."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]


def sorted_arrays(table: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    t = table.select(F.shiftleft("lang", bits).bitwiseOR(F.col("g")).alias("k"), F.log("p").cast("float").alias("lp")).toArrow()
    k, lp = t.column("k").to_numpy().astype(np.uint64), t.column("lp").to_numpy()
    at = np.argsort(k)
    return k[at], lp[at]


def build_model(docs: DataFrame, langs: dict[str, int], held: int = 0) -> Model:
    """All orders, for any text; ``held`` has no effect, nothing is cut."""
    orders = estimate(stored(count_grams(docs, langs), f"grams{ORDER}"))
    return Model([sorted_arrays(g, SYMBOL_BITS * n) for n, (g, _) in enumerate(orders, 1)], [sorted_arrays(c, SYMBOL_BITS * (n - 1)) for n, (_, c) in enumerate(orders, 1)])


def _find(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, v = arrays
    if not len(k):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
    return k[at] == keys, v[at]


def log_probability(model: Model, grams: np.ndarray) -> np.ndarray:
    """Natural log of p(last symbol | symbols before) of packed n-grams."""
    lang, symbols = grams >> np.uint64(SYMBOL_BITS * ORDER), grams & np.uint64((1 << SYMBOL_BITS * ORDER) - 1)
    lp = np.full(len(grams), -SYMBOL_BITS * np.log(2))
    for n in range(1, ORDER + 1):
        bits = SYMBOL_BITS * n
        g = symbols & np.uint64((1 << bits) - 1)
        known, value = _find(model.grams[n - 1], lang << np.uint64(bits) | g)
        context, gamma = _find(model.contexts[n - 1], lang << np.uint64(bits - SYMBOL_BITS) | g >> np.uint64(SYMBOL_BITS))
        lp = np.where(known, value, np.where(context, gamma + lp, lp))
    return lp


def score(docs: DataFrame, model: Model | None, langs: dict[str, int], carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``carry``, all by default) with struct column ``_q``:
    the base counts and ``nll``, the mean negative log probability of a character
    (null for empty texts, and without a model)."""
    carry = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*BASE, "nll", "lang_no"]
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField("_q", T.StructType([*[T.StructField(c, T.LongType()) for c in BASE], T.StructField("nll", T.DoubleType()), T.StructField("lang_no", T.LongType())]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer()
        for b in batches:
            texts, lang = text_column(b), _numbers(b.column("lang"), langs)
            base = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, len(BASE))
            nll = np.full(len(texts), np.nan)
            for lo, hi in pieces(texts) if shared.value else ():
                grams, n = pack(texts[lo:hi], lang[lo:hi])
                kinds = np.unique(grams)
                lp = log_probability(shared.value, kinds)[np.searchsorted(kinds, grams)]
                ends = np.concatenate(([0.0], np.cumsum(lp)))
                stop = np.cumsum(n)
                nll[lo:hi] = np.divide(ends[stop - n] - ends[stop], n, out=np.full(len(n), np.nan), where=n > 0)
            cols = [pa.array(base[:, i]) for i in range(len(BASE))] + [pa.array(nll, from_pandas=True), pa.array(lang)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.StructArray.from_arrays(cols, names)], [*carry, "_q"])

    return docs.mapInArrow(run, schema)


def joined_score(docs: DataFrame, table: DataFrame, langs: dict[str, int], carry: list[str] | None = None) -> DataFrame:
    """``score`` by a join of the distinct n-grams of every text with ``table``
    (lang, g, p), which has all n-grams of ``docs``, whatever its size."""
    carry = docs.columns if carry is None else carry
    keyed = docs.withColumn("_k", text_key())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer()
        for b in batches:
            texts, lang = text_column(b), _numbers(b.column("lang"), langs)
            for t, number, k in zip(texts, lang, b.column("_k").to_pylist()):
                g, c = np.unique(pack([t], np.zeros(1, np.int64))[0], return_counts=True)
                cols = [np.full(len(g), k), np.full(len(g), number), g.astype(np.int64), c.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["k", "lang", "g", "c"])

    grams = keyed.select("_k", "lang", "text").mapInArrow(run, "k long, lang long, g long, c long")
    found = grams.join(table.select("lang", "g", F.log("p").cast("float").cast("double").alias("lp")), ["lang", "g"])
    # a text that is repeated counts as often above as below the line
    nll = found.groupBy("k", "lang").agg((-F.sum(F.col("c") * F.col("lp")) / F.sum("c")).alias("_nll"))
    nll = nll.withColumnsRenamed({"k": "_nk", "lang": "_nl"})
    out = score(keyed, None, langs, [*carry, "_k"])
    out = out.join(nll, (F.col("_k") == F.col("_nk")) & (F.col("_q.lang_no") == F.col("_nl")), "left")
    return out.select(*carry, F.col("_q").withField("nll", F.col("_nll")).alias("_q"))


def base_failed() -> Column:
    return (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))


def bands(scored: DataFrame, below: float, above: float, least_spread: float, min_docs: int) -> DataFrame:
    """(lang_no, low, high): the median nll of the documents of a language that
    pass the base rules, less ``below`` and plus ``above`` median absolute
    deviations.  A language with fewer than ``min_docs`` such documents has no
    band."""
    rows = scored.filter(~base_failed() & F.col("_q.nll").isNotNull()).select("_q.lang_no", "_q.nll")
    mid = rows.groupBy("lang_no").agg(F.percentile_approx("nll", 0.5, 10000).alias("mid"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    off = rows.join(F.broadcast(mid), "lang_no").groupBy("lang_no", "mid").agg(F.percentile_approx(F.abs(F.col("nll") - F.col("mid")), 0.5, 10000).alias("mad"))
    spread = F.greatest("mad", F.lit(least_spread))
    return off.select("lang_no", (F.col("mid") - below * spread).alias("low"), (F.col("mid") + above * spread).alias("high"))


def judge(docs: DataFrame, below: float = 14.0, above: float = 7.0, least_spread: float = 0.015, min_docs: int = 20, broadcast_grams: int = 4_000_000, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``carry``, all by default) with struct column ``_q``: base counts, ``perplexity`` (null for
    empty texts), ``base_failed`` and ``kept``.

    ``kept`` is false if the base rules fail (fewer than 50 words, or more than
    half of the words in repeated windows), else it says whether the perplexity
    lies in the band of the language.  Null texts count as empty and fail; a
    null or rare ``lang`` uses the model and the band that such rows share;
    equal rows get equal verdicts; an empty table gives an empty one.  All n-grams
    count: up to ``broadcast_grams`` of highest order (12 bytes each) are
    broadcast, more are joined, with the same result.
    """
    langs = language_numbers(docs)
    grams = stored(count_grams(docs, langs), f"grams{ORDER}")
    table = estimate(grams)[-1][0]
    if grams.count() <= broadcast_grams:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.float32))  # every n-gram of ``docs`` is known at the highest order
        model = Model([*[none] * (ORDER - 1), sorted_arrays(table, SYMBOL_BITS * ORDER)], [none] * ORDER)
        scored = stored(score(docs, model, langs, carry), "scored")
    else:
        scored = stored(joined_score(docs, table, langs, carry), "scored")
    band = bands(scored, below, above, least_spread, min_docs).withColumnRenamed("lang_no", "_lang_no")  # a row for each of at most 1023 languages
    out = scored.join(F.broadcast(band), F.col("_q.lang_no") == F.col("_lang_no"), "left")
    inside = F.coalesce(F.col("_q.nll").between(F.col("low"), F.col("high")), F.lit(True))
    verdict = F.struct(*[F.col(f"_q.{c}").alias(c) for c in BASE], F.exp("_q.nll").alias("perplexity"), base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))
    return out.select(*(docs.columns if carry is None else carry), verdict.alias("_q"))


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, columns unchanged."""
    return judge(docs, **settings).filter("_q.kept").drop("_q")
