"""Benchmark decontamination by spaced seeds, on DataFrame functions only.

Words are lower-cased runs of letters and digits.  A seed hashes the words at
the marked positions of a fixed mask and ignores the others, so a substituted
word spoils a hit only where it falls on a mark.  Seeds of the benchmark and of
the documents are joined; around each hit the words of the item are compared
with the words of the document on the same diagonal.

The seeds of a benchmark within ``broadcast_seeds`` rows (16 bytes each) are
broadcast; a larger benchmark is joined by a shuffle, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import null_safe_join
from corpusloom.llm.common import text_key, text_of

#: Six words each: one run, and three that leave words out at different places.
MASKS = ("111111", "11011011", "110010111", "1010110101")
RUN = 13
SHARE = 0.8


def word_hashes(column: str = "text") -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text_of(column)), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seed_structs(hashes: str, at: Column, masks: list[str], valid: dict[str, Column] | None = None) -> Column:
    """Seeds that start at position ``at``; null where the mask runs over the
    end or is not ``valid``."""
    seeds = []
    for m in masks:
        marks = [F.get(F.col(hashes), at + i) for i, bit in enumerate(m) if bit == "1"]
        fits = at + len(m) <= F.size(hashes)
        seeds.append(F.when(fits & valid[m] if valid else fits, F.xxhash64(F.lit(m), *marks)))
    return F.array(*seeds)  # nulls go in the join


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, need): distinct items with a word; under five words all are needed."""
    items = benchmark.select("item_id", word_hashes().alias("item")).filter(F.size("item") > 0).distinct()
    n = F.size("item")
    return items.withColumn("need", F.when(n < 5, n).otherwise(F.least(F.lit(RUN), F.ceil(n * SHARE))).cast("int"))


def masks_of(n: int) -> list[str]:
    """Masks one of which is free of substitutions in every passage of an item
    of ``n`` words: all words under five, each single word left out up to nine,
    then a run that ``need`` equal words hold whatever parts them."""
    if n < 5:
        return ["1" * n]
    if n < 10:
        return [("1" * i + "0" + "1" * (n - 1 - i)).strip("0") for i in range(n)]
    return [*MASKS, "111" if n in (10, 11, 15) else "1111"]


def masks_for(items: DataFrame) -> dict[str, Column]:
    """The masks that the lengths of the items need, and the items each is for."""
    lengths: dict[str, set[int]] = {}
    cap = F.least(F.size("item"), F.lit(16))  # longer items have the same masks
    for r in items.select(cap.alias("n")).distinct().collect():
        for m in masks_of(r.n):
            lengths.setdefault(m, set()).add(r.n)
    return {m: cap.isin(sorted(n)) for m, n in sorted(lengths.items())} or {m: F.lit(True) for m in MASKS}


def _stretch(pairs: Column, need: Column) -> Column:
    """Most equal words in a stretch of which at least ``SHARE`` is equal; 0 if
    fewer than ``need`` are equal at all.

    A stretch holds the share if the sum of 1 for an equal and -4 for an unequal
    word does not fall over it; the longest one to a place starts at the first
    of the lowest sums so far that is no higher.
    """
    low = F.array(F.struct(F.lit(0).alias("score"), F.lit(0).alias("run")))
    zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("run"), low.alias("low"), F.lit(0).alias("best"))

    def step(acc: Column, same: Column) -> Column:
        score = acc["score"] + F.when(same, 1).otherwise(-4)
        run = acc["run"] + F.when(same, 1).otherwise(0)
        start = F.get(F.filter(acc["low"], lambda x: x["score"] <= score), F.lit(0))
        lowest = F.element_at(acc["low"], -1)["score"]
        lows = F.when(score < lowest, F.concat(acc["low"], F.array(F.struct(score.alias("score"), run.alias("run"))))).otherwise(acc["low"])
        return F.struct(score.alias("score"), run.alias("run"), lows.alias("low"), F.greatest(acc["best"], F.coalesce(run - start["run"], F.lit(0))).alias("best"))

    enough = F.size(F.filter(pairs, lambda same: same)) >= need
    return F.when(enough, F.aggregate(pairs, zero, step, lambda a: a["best"])).otherwise(0)


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = 4_000_000) -> DataFrame:
    """(doc_id, text_key, item_id, matched, item_words, share) of documents that
    hold a passage of an item.

    A passage is held if on one diagonal a stretch of which at least four fifths
    are equal has 13 equal words, or four fifths of a shorter item, wherever the
    others fall.  Items of fewer than five words are held as a whole word run.
    Null and empty texts hold nothing; equal rows give equal results and are
    returned once; a null doc_id or item_id is a value like any other.
    """
    items = benchmark_items(benchmark)
    valid = masks_for(items)
    masks = list(valid)
    seeds = items.select("item_id", F.size("item").alias("item_words"), "item", F.explode(F.sequence(F.lit(0), F.size("item") - 1)).alias("q"))
    seeds = seeds.select(F.explode(seed_structs("item", F.col("q"), masks, valid)).alias("seed"), "item_id", "item_words", "q").distinct()
    seeds = F.broadcast(seeds) if seeds.count() <= broadcast_seeds else seeds.hint("merge")
    rows = docs.select("doc_id", text_key().alias("text_key"), word_hashes().alias("words"))
    at = rows.select("doc_id", "text_key", "words", F.explode(F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))).alias("p"))
    probes = at.select("doc_id", "text_key", "p", F.explode(seed_structs("words", F.col("p"), masks)).alias("seed"))
    # the item's words lie beside the document's from `start` on, the first `skip` of them before the document's beginning
    start, skip = F.greatest(F.col("p") - F.col("q"), F.lit(0)), F.greatest(F.col("q") - F.col("p"), F.lit(0))
    hits = probes.join(seeds, "seed").select("doc_id", "text_key", F.struct("item_id", start.alias("start"), skip.alias("skip"), (F.col("item_words") - skip).alias("n")).alias("hit"))
    per_doc = hits.groupBy("doc_id", "text_key").agg(F.collect_set("hit").alias("hits"))
    found = null_safe_join(docs.select("doc_id", text_key().alias("text_key"), "text"), per_doc, ["doc_id", "text_key"], "inner")
    found = found.select("doc_id", "text_key", "hits", word_hashes().alias("words"))
    near = found.select("doc_id", "text_key", F.explode(F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["skip"].alias("skip"), F.slice("words", h["start"] + 1, h["n"]).alias("beside")))).alias("x"))
    near = near.select("doc_id", "text_key", "x.*").distinct()
    both = null_safe_join(near, items, ["item_id"], "inner")
    same = F.zip_with(F.slice("item", F.col("skip") + 1, F.size("beside")), "beside", lambda a, b: F.coalesce(a == b, F.lit(False)))
    both = both.select("doc_id", "text_key", "item_id", F.size("item").alias("item_words"), "need", same.alias("same"))
    scored = both.select("doc_id", "text_key", "item_id", "item_words", "need", _stretch(F.col("same"), F.col("need")).alias("matched"))
    held = scored.filter(F.col("matched") >= F.col("need"))
    best = held.groupBy("doc_id", "text_key", "item_id").agg(F.max("matched").alias("matched"), F.max("item_words").alias("item_words"))
    return best.withColumn("share", F.round(F.col("matched") / F.col("item_words"), 6))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark."""
    found = contaminated(docs, benchmark).select("doc_id", F.col("text_key").alias("_text_key")).distinct()
    keyed = docs.withColumn("_text_key", text_key())
    return null_safe_join(keyed, found, ["doc_id", "_text_key"], "left_anti").drop("_text_key")
