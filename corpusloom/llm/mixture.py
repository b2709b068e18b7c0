"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a hash, form a stream of words that may
repeat up to ``cap`` times; the stream is cut into blocks of equal length.
Slot k of the schedule goes to the source whose interval of cumulative target
shares holds the k-th point of the golden-ratio sequence; the slots of a source
are ranked and slot rank r takes block r of its stream.  Any stretch of slots
thus mixes the sources close to their shares.  A source that got a few slots
fewer than it has blocks (the discrepancy) has the rest appended at the end.

Running sums, ranks and the search in the cumulative shares are sorts over
range partitions, so neither a large source nor many sources meet in one task.
Each step is stored, so that the driver never holds one plan of all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import null_safe_join, ordinal, scan
from corpusloom.llm.common import WORD, release, stored, text_key, text_of

GOLDEN = 0.6180339887498949


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(source, sid, source_size, target) from (source, size).

    Sources weigh 1, 2, 3, 1, ... by code point, null last, and share the sum
    of all sizes; none exceeds ``cap`` times its size, and what that leaves
    goes to the others by weight.  The limit of this resharing is a level L
    with target = min(L * weight, cap * size): sources are capped in the order
    of cap * size / weight, and L is known once the next one isn't.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = ordinal(per, [F.col("source").asc_nulls_last()], out="sid")
    per = per.withColumn("weight", (F.col("sid") - 1) % 3 + 1).withColumn("most", cap * F.col("source_size"))
    per = per.withColumn("_ratio", F.col("most") / F.col("weight"))
    run = scan(per, [], ["_ratio", "sid"], {"_most": ("sum", F.col("most")), "_weight": ("sum", F.col("weight"))}, before_only=True)
    total = per.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    run = run.join(F.broadcast(total))  # one row
    level = (F.col("_all") - F.coalesce("_most", F.lit(0))) / (F.col("_weights") - F.coalesce("_weight", F.lit(0)))
    level = run.agg(F.max(level).alias("_level"))  # capping a source raises it until no source is above its cap, then lowers it
    out = per.join(F.broadcast(level))  # one row
    return out.select("source", "sid", "source_size", F.least(F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"), F.col("most").cast("double")).alias("target"))


def schedule(aims: DataFrame, block: int) -> DataFrame:
    """(sid, rank, slot): the slot of each block of each source, from 1."""
    need = aims.select("sid", F.ceil(F.round("target") / block).cast("long").alias("blocks")).filter("blocks > 0")
    need = stored(scan(need, [], ["sid"], {"_before": ("sum", F.col("blocks"))}, before_only=True), "blocks")
    total = need.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    edges = need.select((F.coalesce("_before", F.lit(0)) / F.lit(max(total, 1))).alias("x"), F.lit(0).cast("long").alias("slot"), "sid")
    spark = aims.sparkSession
    k = F.col("id")
    points = spark.range(1, total + 1).select((k * GOLDEN - F.floor(k * GOLDEN)).alias("x"), k.alias("slot"), F.lit(None).cast(edges.schema["sid"].dataType).alias("sid"))
    # the last edge at or before a point names its source
    placed = scan(edges.unionByName(points), [], ["x", "slot"], {"of": ("max", F.col("sid"))})
    ranked = stored(ordinal(placed.filter("slot > 0").select(F.col("of").alias("sid"), "slot"), ["slot"], ["sid"], "rank"), "ranked-slots")
    got = ranked.groupBy("sid").agg(F.max("rank").alias("got"))
    late = need.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < blocks")
    late = late.select("sid", F.explode(F.sequence(F.col("got") + 1, F.col("blocks"))).alias("rank"))
    late = ordinal(late, ["rank", "sid"], out="slot").withColumn("slot", F.col("slot") + total)
    used = ranked.join(need.select("sid", "blocks"), "sid").filter("rank <= blocks")
    return used.select("sid", "rank", "slot").unionByName(late.select("sid", "rank", "slot"))


def mix(docs: DataFrame, cap: int = 3, block: int = 512) -> DataFrame:
    """(doc_id, text_key, size, source_size, target, taken, first_slot), one row
    per row of ``docs``.

    ``taken`` counts the words that the mix takes from the document, repeats
    included, at most ``cap`` times its size; the sum over a source is its
    target, rounded.  ``first_slot`` is null for documents that are not taken.
    Null and empty texts have size 0 and are never taken; a null source is a
    source; repeated rows are documents of their own.  Reruns agree.
    """
    rows = docs.select("doc_id", text_key().alias("text_key"), "source", F.expr(f"regexp_count(coalesce(text, ''), r'{WORD}')").cast("long").alias("size"))
    rows = stored(rows, "sizes")
    aims = stored(targets(rows, cap), "targets")
    slots = stored(schedule(aims, block), "slots")
    release(docs.sparkSession)
    sized = null_safe_join(rows, aims, ["source"], "inner")
    order = [F.xxhash64("doc_id", "text_key"), "doc_id", "text_key", "size"]
    at = stored(scan(sized, ["sid"], order, {"_end": ("sum", F.col("size")), "_pos": ("sum", F.lit(1).cast("long"))}), "streams")
    release(docs.sparkSession)
    begin, end, want = F.col("_end") - F.col("size") + F.col("_turn") * F.col("source_size"), F.col("_end") + F.col("_turn") * F.col("source_size"), F.round("target").cast("long")
    turns = at.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)).cast("array<long>")))
    turns = turns.withColumn("_from", begin).withColumn("_to", F.least(end, want))
    blocks = F.when(F.col("_to") > F.col("_from"), F.sequence(F.floor(F.col("_from") / block) + 1, F.floor((F.col("_to") - 1) / block) + 1))
    cut = turns.select("sid", "_pos", "doc_id", "text_key", "size", "source_size", "target", "_from", "_to", F.explode_outer(blocks).alias("rank"))
    taken = F.least(F.col("_to"), F.col("rank") * block) - F.greatest(F.col("_from"), (F.col("rank") - 1) * block)
    joined = cut.join(slots, ["sid", "rank"], "left")
    keys = ["sid", "_pos", "doc_id", "text_key", "size", "source_size", "target"]
    out = joined.groupBy(*keys).agg(F.sum(F.when(F.col("slot").isNotNull(), taken).otherwise(0)).alias("taken"), F.min("slot").alias("first_slot"))
    return out.drop("sid", "_pos")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The taken rows of ``docs`` with ``size``, ``source_size``, ``target``,
    ``taken`` and ``first_slot``; input columns of these names are replaced.
    Equal rows are one row whose ``taken`` is that of all of them."""
    new = ["size", "source_size", "target", "taken", "first_slot"]
    plan = mix(docs, **settings)
    plan = plan.groupBy("doc_id", F.col("text_key").alias("_text_key"), "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.min("first_slot").alias("first_slot")).filter("taken > 0")
    keyed = docs.drop(*new).withColumn("_text_key", text_key())
    return null_safe_join(keyed, plan, ["doc_id", "_text_key"], "inner").drop("_text_key").distinct()
