"""Text operators that work on whole tables: clauses, tokenisation repair, fuzzy keys, lemma lookup."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx
from corpusloom.functions.scale import cut_lineage, kept, shuffle_width


def clause_ranges(text: Column, n_words: Column, letter: str, mark: str) -> Column:
    """Array of (first, last) word numbers of clauses closed by a pause mark.

    A piece of text is a word when it holds a letter; null when the number of
    words differs from ``n_words``.
    """
    start = F.struct(
        F.lit(0).alias("w"),
        F.lit(1).alias("open"),
        F.array().cast("array<struct<first:int,last:int>>").alias("done"),
    )

    def step(acc, tok):
        w = acc["w"] + F.when(F.regexp_replace(tok, mark, "").rlike(letter), 1).otherwise(0)
        closes = tok.rlike(mark) & (w >= acc["open"])
        piece = F.struct(acc["open"].alias("first"), w.alias("last"))
        return F.struct(
            w.alias("w"),
            F.when(closes, w + 1).otherwise(acc["open"]).alias("open"),
            F.when(closes, F.array_append(acc["done"], piece)).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc):
        tail = F.struct(acc["open"].alias("first"), acc["w"].alias("last"))
        done = F.when(acc["w"] >= acc["open"], F.array_append(acc["done"], tail)).otherwise(acc["done"])
        return F.when(acc["w"] == n_words, done)

    return F.aggregate(tx.words(text), start, step, finish)


def reconcile_tokens(df: DataFrame, tokens: str, target: str, particles: Sequence[str], pairs: Sequence[tuple], triples: Sequence[tuple], out: str = "aligned") -> DataFrame:
    """Merge fixed word runs left to right until a unit has ``target`` tokens; null when it cannot."""
    parts, twos, threes = set(particles), set(map(tuple, pairs)), set(map(tuple, triples))

    def merge(words, want):
        words = list(words)
        done, i = [], 0
        excess = len(words) - want
        while i < len(words):
            take = 1
            while excess > 0:  # a merged token may start another listed run
                rest = words[i + take :]
                head = " ".join(words[i : i + take])
                if len(rest) >= 2 and (head, *rest[:2]) in threes:
                    step = 2
                elif rest and ((head, rest[0]) in twos or head in parts):
                    step = 1
                else:
                    break
                take, excess = take + step, excess - step
            done.append(" ".join(words[i : i + take]))
            i += take
        return done if len(done) == want else None

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def merged(ws: pd.Series, want: pd.Series) -> pd.Series:
        return pd.Series([merge(w, n) for w, n in zip(ws, want)])

    return df.withColumn(out, merged(F.col(tokens), F.col(target)))


def _variants(df: DataFrame, word: str, depth: int) -> DataFrame:
    """(word, variant) rows: the non-weak letters with up to ``depth`` of them left out."""
    level = df.select(word, F.regexp_replace(word, f"[{tx.WEAK}]", "").alias("v"))
    out = level
    for _ in range(depth):
        spots = F.sequence(F.lit(1), F.greatest(F.length("v"), F.lit(1)))
        level = (
            level.filter(F.length("v") > 0)
            .select(
                word,
                F.explode(
                    F.transform(spots, lambda i: F.concat(F.substr("v", F.lit(1), i - 1), F.substr("v", i + 1)))
                ).alias("v"),
            )
            .distinct()
        )
        out = out.unionByName(level)
    return out.distinct()


def weak_distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``weak_distance`` of many pairs of words at once, one table cell of all of them at a time."""
    words = [[w for w in side] for side in (a, b)]
    sizes = [np.array([len(w) for w in side], dtype=np.int64) for side in words]
    x, y = (np.zeros((max(size.max(initial=0), 1), len(side)), dtype=np.uint32) for side, size in zip(words, sizes))
    for table, side in ((x, words[0]), (y, words[1])):
        for k, w in enumerate(side):
            table[: len(w), k] = np.frombuffer(w.encode("utf-32-le"), dtype="<u4")
    weak = np.array([ord(c) for c in tx.WEAK], dtype=np.uint32)
    wx, wy = np.isin(x, weak), np.isin(y, weak)
    cx, cy = np.where(wx, 0.5, 1.0), np.where(wy, 0.5, 1.0)
    row = np.repeat(np.arange(len(y) + 1, dtype=np.float64)[:, None], len(words[0]), axis=1)
    for i in range(sizes[0].max(initial=0)):
        new = np.empty_like(row)
        new[0] = row[0] + 1.0
        change = np.where(x[i] == y, 0.0, np.where(wx[i] & wy, 0.3, 1.0))
        for j in range(1, len(row)):
            new[j] = np.minimum(np.minimum(row[j - 1] + change[j - 1], row[j] + cx[i]), new[j - 1] + cy[j - 1])
        row = np.where(i < sizes[0], new, row)
    return row[sizes[1], np.arange(len(words[0]))]


def with_weak_distance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Column ``dist``, ``weak_distance`` of both words to six digits; neither may be null."""

    @F.pandas_udf("double")
    def dist(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(weak_distances(x.tolist(), y.tolist()))

    # as a deterministic column it would run again in every filter on its result
    return pairs.withColumn("dist", F.round(dist.asNondeterministic()(a, b), 6))


def fuzzy_pairs(forms: DataFrame, keys: DataFrame, max_distance: float) -> DataFrame:
    """Pairs (form, key, dist) with weighted edit distance up to ``max_distance``.

    Weak letters are cheap but every other edit costs one, so two words that
    close agree in their non-weak letters after leaving out at most
    ``floor(max_distance)`` on each side: an equi-join finds all of them.
    """
    depth = int(max_distance)
    left = _variants(forms.select("form").distinct(), "form", depth)
    right = _variants(keys.select("key").distinct(), "key", depth)
    close = left.join(right, "v").select("form", "key").distinct()
    return with_weak_distance(close, "form", "key").filter(F.col("dist") <= max_distance)


def _nearest_in_lists(rows: DataFrame, band: float) -> DataFrame:
    """(form, key, dist) of the keys of each row (form, keys) within ``band`` of the best of the row."""

    @F.pandas_udf("array<struct<key:string,dist:double>>")
    def near(forms: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for form, keys in zip(forms, lists):
            dist = np.round(weak_distances([form] * len(keys), list(keys)), 6)
            out.append([(keys[i], dist[i]) for i in np.flatnonzero(dist <= dist.min() + band + 1e-6)])
        return pd.Series(out)

    return rows.select("form", F.explode(near("form", "keys")).alias("n")).select("form", "n.key", F.round("n.dist", 6).alias("dist"))


def nearest_keys(forms: DataFrame, keys: DataFrame, band: float = 0.3, max_depth: int = 3, block: int = 64) -> DataFrame:
    """Keys within ``band`` of each form's best distance, ties by frequency; every
    form gets its best key however far.

    Works outward: forms whose best match is settled at one distance leave the
    pool, only the rest are compared at the next.  Where the spellings to try
    would be more rows than the pairs left, and for those that no key comes near
    within ``max_depth`` edits, forms are compared with all keys, in lists of
    about ``block`` thousand letters each, of which only the nearest come back.
    ``keys`` has (key, freq).
    """
    todo = kept(forms.select("form").distinct(), "forms")
    keys = kept(keys.select("key", "freq"), "keys")  # read by every round
    found = None

    def settle(pairs: DataFrame, limit: float | None) -> DataFrame:
        nonlocal found
        best = pairs.groupBy("form").agg(F.min("dist").alias("best"))
        best = best if limit is None else best.filter(F.col("best") <= limit)
        done = pairs.join(best, "form").filter(F.round(F.col("dist") - F.col("best"), 6) <= band)
        found = done if found is None else found.unionByName(done)
        return best

    words = keys.filter("key IS NOT NULL").select("key").distinct()
    size = F.length(F.regexp_replace("key", f"[{tx.WEAK}]", "")).cast("double")
    total, letters, *spellings = words.agg(F.count(F.lit(1)), F.sum(F.length("key")), *[F.sum(F.pow(size, F.lit(d))) for d in range(1, max_depth + 1)]).first()
    for reach in range(1, max_depth + 1):
        left = todo.filter("form IS NOT NULL").count()
        if not left or left * total <= (spellings[reach - 1] or 0) / math.factorial(reach):
            break
        best = settle(kept(fuzzy_pairs(todo, keys, reach + 0.999), "fuzzy-pairs"), reach + 0.999 - band)
        todo = cut_lineage(todo.join(best, "form", "left_anti"))
    if found is None or todo.filter("form IS NOT NULL").count():
        lists = max(1, -(-int(letters or 0) // (1000 * block)))
        listed = words.groupBy(F.pmod(F.xxhash64("key"), F.lit(lists)).alias("_l")).agg(F.collect_list("key").alias("keys"))
        some = todo.filter("form IS NOT NULL").repartition(shuffle_width(todo.sparkSession), "form").crossJoin(listed.select("keys"))
        settle(kept(_nearest_in_lists(some, band), "fuzzy-pairs"), None)
    ranked = found.join(keys, "key").select("form", "key", "dist", "freq")
    from pyspark.sql import Window

    w = Window.partitionBy("form").orderBy("dist", F.desc("freq"), "key")
    return ranked.withColumn("rank", F.row_number().over(w).cast("long"))


def resolve_lemmas(names: DataFrame, lemmas: DataFrame, preset: str) -> DataFrame:
    """One lemma id per name: by skeleton, then by exact spelling; status tells failures apart."""
    skeleton = lemmas.select("lemma_id", "lemma", tx.fold(F.col("lemma"), preset).alias("skel"))
    cand = names.select("name", tx.fold(F.col("name"), preset).alias("skel")).join(skeleton, "skel", "left")
    counted = cand.groupBy("name").agg(
        F.countDistinct("lemma_id").alias("n_skel"),
        F.min("lemma_id").alias("any_id"),
        F.min(F.when(F.col("lemma") == F.col("name"), F.col("lemma_id"))).alias("exact_id"),
    )
    return counted.select(
        "name",
        F.when(F.col("n_skel") == 1, F.col("any_id")).otherwise(F.col("exact_id")).alias("lemma_id"),
        F.when(F.col("n_skel") == 1, F.lit("skeleton"))
        .when(F.col("exact_id").isNotNull(), F.lit("exact"))
        .when(F.col("n_skel") == 0, F.lit("unknown"))
        .otherwise(F.lit("ambiguous"))
        .alias("status"),
    )
