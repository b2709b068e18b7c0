"""Line dedup by a log-template tree of fixed depth, on DataFrame functions only.

Tree: a line goes to a leaf by its number of tokens and its first ``leading``
tokens, where a token with a digit is the wildcard ``<*>``.  In a leaf, a token
at a position is constant if lines of at least ``min_docs`` documents have it
there; every other position is a variable field and becomes a wildcard too.
The line with its wildcards is its template.  A template recurs if at least
``constant_percent`` of its tokens are constant and it occurs in ``min_docs`` documents;
documents count by their text, so exact copies of a document count once.

Only the number of lines is counted for all leaves; tokens are looked at in
leaves of enough lines, once for each different line.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import null_safe_join
from corpusloom.llm.common import stored, text_key, text_of

WILD = "<*>"


def lines_of(docs: DataFrame, leading: int) -> DataFrame:
    """(doc_id, text_key, line_no, leaf, masked): lines with at least one token."""
    cut = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(F.split(text_of(), "\n")).alias("line_no", "line"))
    odd = reduce(or_, [F.contains("line", F.lit(x)) for x in ("  ", "\t", "\v", "\f", "\r")])  # few lines need the costlier replacement
    plain = F.when(odd, F.regexp_replace("line", r"[\x20\x09-\x0D]+", " ")).otherwise(F.col("line"))
    flat = F.trim(plain)
    masked = F.when(F.col("flat").rlike("[0-9]"), F.regexp_replace("flat", r"[^ ]*[0-9][^ ]*", WILD)).otherwise(F.col("flat"))
    rows = cut.withColumn("flat", flat).filter("flat <> ''").withColumn("masked", masked)
    count = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64(count, F.substring_index("masked", " ", leading))
    return rows.select("doc_id", "text_key", "line_no", leaf.alias("leaf"), "masked")


def recurring_lines(docs: DataFrame, leading: int = 3, min_docs: int = 5, constant_percent: int = 60, broadcast_leaves: int = 2_000_000) -> DataFrame:
    """(doc_id, text_key, line_no, template, first): the lines whose template
    recurs; ``first`` marks the line of the smallest (doc_id, text_key, line_no),
    null ids last.

    The leaves of enough lines are broadcast (8 bytes each) up to
    ``broadcast_leaves``, else joined by a shuffle, with the same result.
    """
    every = lines_of(docs, leading)
    full = stored(every.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("leaf"), "leaves")
    full = F.broadcast(full) if full.count() <= broadcast_leaves else full
    lines = stored(every.join(full, "leaf", "left_semi").withColumn("h", F.xxhash64("masked")), "lines")
    kinds = lines.groupBy("leaf", "h", "masked", "text_key").agg(F.lit(1).alias("one")).groupBy("leaf", "h", "masked").agg(F.sum("one").alias("docs"))
    kinds = stored(kinds, "line-kinds")
    tokens = kinds.select("leaf", "h", "docs", F.posexplode(F.transform(F.split("masked", " "), lambda t: F.xxhash64(t))).alias("pos", "token"))
    constant = tokens.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    marked = tokens.join(constant.select("leaf", "pos", "token"), ["leaf", "pos", "token"])
    # the template is the set of its constant (position, token); a sum of hashes names a set whatever the order
    shape = marked.groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("fixed"), F.sum(F.xxhash64("pos", "token") % (1 << 40)).alias("sum"))
    width = kinds.select("leaf", "h", F.size(F.split("masked", " ")).alias("width"))
    template = shape.join(width, ["leaf", "h"]).filter(100 * F.col("fixed") >= constant_percent * F.col("width"))
    # written, so that the join below has a shuffle of its own on both sides and Spark can split a very common line
    template = stored(template.select("leaf", "h", F.xxhash64("leaf", "fixed", "sum").alias("template")), "templates")
    found = lines.select("doc_id", "text_key", "line_no", "leaf", "h").join(template, ["leaf", "h"])
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "line_no")
    by_doc = found.groupBy("template", "text_key").agg(F.min(order).alias("at"))
    often = by_doc.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("at").alias("at")).filter(F.col("docs") >= min_docs)
    out = found.join(stored(often.select("template", "at"), "recurring"), "template")
    first = F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("text_key") == F.col("at.text_key")) & (F.col("line_no") == F.col("at.line_no"))
    return out.select("doc_id", "text_key", "line_no", "template", first.alias("first"))


def drop_lines(docs: DataFrame, keep_first: bool = True, **settings) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and ``n_lines``
    and ``n_dropped`` (lines with a token, and those dropped) added.

    The first line of a template stays, so that no content leaves the corpus
    whole; ``keep_first=False`` drops it too.  Texts without a recurring line,
    null and empty ones included, stay as they are, blank lines too; a text may
    become empty, its row stays.  Equal rows are changed alike, a null doc_id is
    an id like any other; an input column of the same name is replaced.
    """
    lines = recurring_lines(docs, **settings)
    gone = lines.filter(~F.col("first")) if keep_first else lines
    per_doc = gone.groupBy("doc_id", F.col("text_key").alias("_text_key")).agg(F.array_sort(F.collect_set("line_no")).alias("_gone"))
    keyed = docs.drop("n_lines", "n_dropped").withColumn("_text_key", text_key())
    out = null_safe_join(keyed, per_doc, ["doc_id", "_text_key"], "left")
    cut = F.split("text", "\n")
    # what stays lies between two neighbouring dropped lines, so long texts cost no more than their length
    bounds = F.concat(F.array(F.lit(-1)), "_gone", F.array(F.size(cut)))
    slices = F.transform(F.sequence(F.lit(1), F.size("_gone") + 1), lambda k: F.slice(cut, F.get(bounds, k - 1) + 2, F.get(bounds, k) - F.get(bounds, k - 1) - 1))
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(slices), "\n"))
    n_lines = F.size(F.filter(F.split(text_of(), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    out = out.select("*", n_lines.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
    out = out.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))
    return out.withColumn("text", left).drop("_text_key", "_gone")
