"""Relational model of a corpus: views, lookups, roll-ups, ranges, documents and dictionaries.

Column vocabulary: ``grp`` (group), ``pos`` (place of a unit in its group),
``unit_id``, ``tok_no``, ``seg_no``, ``key``, ``subkey``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.scale import collect_chunked, cut_lineage, neighbours, ordinal, scan


# --- views and lookups --------------------------------------------------------
def token_view(tokens: DataFrame, units: DataFrame, groups: DataFrame, keys: DataFrame, subkeys: DataFrame) -> DataFrame:
    """Tokens with their unit and group; keys and subkeys stay optional."""
    return tokens.join(units, "unit_id").join(groups, "grp").join(keys, "key_id", "left").join(subkeys, "subkey_id", "left")


def segment_view(segments: DataFrame, tags: DataFrame, keys: DataFrame, subkeys: DataFrame) -> DataFrame:
    return segments.join(tags, "tag").join(keys, "key_id", "left").join(subkeys, "subkey_id", "left")


def key_map(view: DataFrame, key: str, order: Sequence, limit: int | None = None) -> DataFrame:
    """Occurrences of one key in corpus order."""
    hits = view.filter(F.col("key") == key).orderBy(*order)
    return hits if limit is None else hits.limit(limit)


def lookup(df: DataFrame, order: Sequence, **equal) -> DataFrame:
    """Rows with the given values; equality filters reach the parquet scan."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == value)
    return df.orderBy(*order)


def search(df: DataFrame, column: str, text: str, order: Sequence, limit: int, how: str = "contains") -> DataFrame:
    """``how``: exact, contains or prefix."""
    c = F.col(column)
    cond = {"exact": c == text, "contains": c.contains(text), "prefix": c.startswith(text)}[how]
    return df.filter(cond).orderBy(*order).limit(limit)


def units_with_both(tokens: DataFrame, first: str, second: str, unit: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Units that hold both keys, in one pass over the tokens of either key."""
    return (
        tokens.filter(F.col("key").isin(first, second))
        .groupBy(*unit)
        .agg(F.bool_or(F.col("key") == first).alias("_a"), F.bool_or(F.col("key") == second).alias("_b"))
        .filter("_a AND _b")
        .select(*unit)
    )


def hapax(df: DataFrame, value: str, place: Sequence[str]) -> DataFrame:
    """Values that occur once, with their place (compared as numbers)."""
    found = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*place)).alias("_p"))
    return found.filter("_n = 1").select(value, *[F.col(f"_p.{p}").alias(p) for p in place])


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b, ...) whose two ends are in ``nodes`` (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "a"), "a", "left_semi").join(n.withColumnRenamed("node", "b"), "b", "left_semi")


def integrity(tokens: DataFrame, units: DataFrame, segments: DataFrame, tags: DataFrame) -> DataFrame:
    """Counts of orphan tokens, unknown tags, empty units and tokens with several stems."""
    one = F.count(F.lit(1)).alias("n")
    parts = {
        "orphan tokens": tokens.join(units, "unit_id", "left_anti").agg(one),
        "unknown tags": segments.join(tags, "tag", "left_anti").agg(one),
        "empty units": units.join(tokens, "unit_id", "left_anti").agg(one),
        "several stems": segments.filter("role = 'stem'").groupBy("token_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(one),
    }
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# --- roll-ups -----------------------------------------------------------------
def first_stem(segments: DataFrame, token: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each token takes the fields of its first stem segment."""
    pick = F.min_by(F.struct(*fields), F.when(F.col("role") == "stem", F.col("seg_no")))
    return segments.groupBy(*token).agg(pick.alias("_f"), F.count(F.lit(1)).alias("n_segments")).select(*token, *[F.col(f"_f.{f}").alias(f) for f in fields], "n_segments")


def majority(df: DataFrame, item: str, label: str, order: Column) -> DataFrame:
    """Most frequent label per item; ties go to the label seen first."""
    votes = df.filter(F.col(label).isNotNull() & F.col(item).isNotNull()).groupBy(item, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    best = votes.groupBy(item).agg(F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col("seen"), F.col(label))).alias("b"))
    return best.select(item, F.col(f"b.{label}").alias(label), F.col("b.n").alias("n"))


def surrogate_ids(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Ids 1..n in the order in which values are first seen."""
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    return ordinal(first, ["_first", value], out="id").select(value, "id")


def division_of(units: DataFrame, starts: DataFrame, place: Sequence[str], out: str = "division") -> DataFrame:
    """Last division that starts at or before each unit, 0 before the first.

    ``starts`` has (division, *place); boundaries and units are merged in one
    ordered scan, so the number of divisions does not matter.
    """
    keep = [c for c in units.columns if c not in place]
    marks = starts.select(*place, F.lit(0).alias("_side"), F.col("division").alias("_d"), *[F.lit(None).alias(c) for c in keep])
    rows = units.select(*place, F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_d"), *keep)
    merged = rows.unionByName(marks)
    ran = scan(merged, [], [*place, "_side", *keep], {out: ("max", F.col("_d"))})
    return ran.filter("_side = 1").withColumn(out, F.coalesce(out, F.lit(0))).drop("_side", "_d")


def coarser(division: Column, size: int) -> Column:
    return F.floor((division - 1) / size).cast("long") + 1


# --- nested documents ---------------------------------------------------------
def texts_by_language(rows: DataFrame, unit: str, lang: str, text: str) -> DataFrame:
    """Map language → text per unit (one text per language)."""
    return rows.groupBy(unit).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(lang, text)))).alias("texts"))


def token_documents(segments: DataFrame, token: Sequence[str], order: Sequence[str], fields: Sequence[str], size: int = 1000) -> DataFrame:
    """One JSON array of segments per token and part; empty fields are left out."""
    doc = F.struct(*fields)
    parts = collect_chunked(segments, token, [*order, *fields], {"segments": doc}, size)
    return parts.withColumn("segments", F.to_json("segments"))


def key_documents(tokens: DataFrame, place: Sequence[str], meanings: DataFrame | None = None, size: int = 1000) -> DataFrame:
    """Per key: its subkeys by frequency and its addresses, both in bounded parts."""
    known = tokens.filter(F.col("key").isNotNull())
    subs = known.filter(F.col("subkey").isNotNull()).groupBy("key", "subkey").agg(F.count(F.lit(1)).alias("n"))
    sub_parts = collect_chunked(subs, ["key"], [F.desc("n"), "subkey"], {"subkeys": F.col("subkey").cast("string")}, size)
    spots = known.select("key", *place).distinct()
    spot_parts = collect_chunked(spots, ["key"], place, {"places": tx.address(*[F.col(p) for p in place])}, size)
    out = sub_parts.join(spot_parts, ["key", "part"], "full_outer")
    if meanings is not None:
        out = out.join(meanings, "key", "left")
    return out


# --- runs and ranges ----------------------------------------------------------
def collapse_runs(df: DataFrame, text: str) -> DataFrame:
    """Consecutive equal texts of a group become (grp, first, last, text, n)."""
    near = neighbours(df.select("grp", "pos", text), ["grp"], ["pos"], [text], before=1, after=0)
    prev = F.col("near")[F.lit(-1)][text]
    flagged = near.select("grp", "pos", text, F.when(prev.eqNullSafe(F.col(text)), 0).otherwise(1).alias("_new"))
    islands = scan(flagged, ["grp"], ["pos"], {"_run": ("sum", F.col("_new"))})
    runs = islands.groupBy("grp", "_run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first(text).alias(text), F.count(F.lit(1)).alias("n"))
    return runs.drop("_run")


def merge_ranges(df: DataFrame) -> DataFrame:
    """Join ranges (grp, first, last) that overlap or touch."""
    r = df.select("grp", "first", "last").distinct()
    ran = scan(r, ["grp"], ["first", "last"], {"_reach": ("max", F.col("last"))}, before_only=True)
    flagged = ran.withColumn("_new", F.when(F.col("first") <= F.col("_reach") + 1, 0).otherwise(1))
    islands = scan(flagged, ["grp"], ["first", "last"], {"_run": ("sum", F.col("_new"))})
    return islands.groupBy("grp", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def tile_ranges(ranges: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair ranges (grp, first, last, id) into a tiling of 1..size per group.

    Reversed ends are swapped, ends beyond the group clamped, ranges outside
    or covered dropped, overlaps trimmed, gaps closed by stretching the range
    before.  After those rules a range runs from its own start to the next
    kept start, so two running maxima and one running minimum settle
    everything.  Returns the tiling and the number of fixes by kind.
    """
    r = ranges.join(sizes, "grp").select(
        "grp",
        "id",
        "size",
        F.least("first", "last").alias("a"),
        F.greatest("first", "last").alias("b0"),
        (F.col("last") < F.col("first")).alias("swapped"),
    )
    r = r.withColumn("clamped", F.col("b0") > F.col("size")).withColumn("b", F.least("b0", "size"))
    inside = r.filter(F.col("a") <= F.col("size"))
    ran = scan(inside, ["grp"], ["a", "b", "id"], {"reach": ("max", F.col("b"))}, before_only=True)
    ran = ran.withColumn("overlap", F.coalesce(F.col("a") <= F.col("reach"), F.lit(False)))
    ran = ran.withColumn("covered", F.coalesce(F.col("b") <= F.col("reach"), F.lit(False)))
    ran = ran.withColumn(
        "gap",
        ~F.col("covered") & F.when(F.col("reach").isNull(), F.col("a") > 1).otherwise(F.col("a") > F.col("reach") + 1),
    )
    kept = ran.filter(~F.col("covered")).withColumn("first", F.when(F.col("reach").isNull(), F.lit(1)).otherwise(F.greatest(F.col("a"), F.col("reach") + 1)))
    ended = scan(kept, ["grp"], [F.desc("first"), F.desc("id")], {"next": ("min", F.col("first"))}, before_only=True)
    tiles = ended.select("grp", "first", F.coalesce(F.col("next") - 1, F.col("size")).alias("last"), "id")
    tail = kept.groupBy("grp").agg(F.max("b").alias("b"), F.max("size").alias("size")).filter("b < size")

    def tally(df, cond, kind):
        return df.filter(cond).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")

    fixes = (
        tally(r, F.col("swapped"), "swap")
        .unionByName(tally(r, F.col("clamped"), "clamp"))
        .unionByName(tally(ran, F.col("overlap"), "overlap"))
        .unionByName(tally(r.select("a", "size").withColumn("o", F.col("a") > F.col("size")), F.col("o"), "outside"))
        .unionByName(tally(ran, F.col("covered"), "covered"))
        .unionByName(tally(ran.select("gap").unionByName(tail.select(F.lit(True).alias("gap"))), F.col("gap"), "gap"))
    )
    return tiles, fixes


RANGE_CELL = 4096


def in_range(points: DataFrame, ranges: DataFrame, how: str = "inner", cell: int = RANGE_CELL) -> DataFrame:
    """Join points (grp, pos) to the ranges (grp, first, last, ...) that hold them.

    Both meet in cells of fixed width, so a range of any length is one row per
    cell; points in a cell that a range only touches are compared.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    spread = ranges.withColumn("_cell", F.explode(F.sequence(at("first"), at("last")))).withColumnRenamed("grp", "_grp")
    on = (F.col("grp") == F.col("_grp")) & (at("pos") == F.col("_cell")) & F.col("pos").between(F.col("first"), F.col("last"))
    return points.join(spread, on, how).drop("_grp", "_cell")


def first_of(units: DataFrame, division: str, place: Sequence[str], fields: Sequence[str]) -> DataFrame:
    pick = F.min_by(F.struct(*fields), F.struct(*place))
    return units.groupBy(division).agg(pick.alias("_f")).select(division, *[F.col(f"_f.{f}").alias(f) for f in fields])


def change_points(df: DataFrame, group: Sequence[str], order: Sequence, value: str) -> DataFrame:
    """Rows whose value differs from the row before (the first row counts)."""
    near = neighbours(df, group, order, [value], before=1, after=0)
    prev = F.col("near")[F.lit(-1)][value]
    return near.filter(~prev.eqNullSafe(F.col(value)) | (F.col("_pos") == 1)).drop("near", "_pos")


def group_offsets(sizes: DataFrame) -> DataFrame:
    """(grp, size, offset): units that stand before each group in corpus order."""
    ran = scan(sizes, [], ["grp"], {"offset": ("sum", F.col("size"))}, before_only=True)
    return ran.withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))


def to_ordinal(points: DataFrame, offsets: DataFrame) -> DataFrame:
    return points.join(offsets.select("grp", "offset"), "grp").withColumn("ord", F.col("offset") + F.col("pos")).drop("offset")


def from_ordinal(ords: DataFrame, offsets: DataFrame) -> DataFrame:
    """(ord) → (grp, pos) by the range of ordinals that each group covers."""
    spans = offsets.filter("size > 0").select(F.lit(0).alias("_all"), F.col("grp").alias("_of"), "offset", (F.col("offset") + 1).alias("first"), (F.col("offset") + F.col("size")).alias("last"))
    points = ords.withColumn("grp", F.lit(0)).withColumn("pos", F.col("ord"))
    held = in_range(points, spans.withColumnRenamed("_all", "grp"))
    return held.withColumn("grp", F.col("_of")).withColumn("pos", F.col("ord") - F.col("offset")).drop("_of", "offset", "first", "last")


def context_text(df: DataFrame, before: int, after: int, text: str = "text", sep: str = " | ") -> DataFrame:
    """Text of rows -before..0 and of rows 1..after around each row."""
    near = neighbours(df, ["grp"], ["pos"], [text], before, after)
    at = lambda k: F.col("near")[F.lit(k)][text]
    return near.select(
        "grp",
        "pos",
        F.concat_ws(sep, *[at(k) for k in range(-before, 1)]).alias("left_text"),
        F.concat_ws(sep, *[at(k) for k in range(1, after + 1)]).alias("right_text"),
    )


def span_text(units: DataFrame, spans: DataFrame, cap: int, sep: str = " ") -> DataFrame:
    """Text of each span cut at ``cap`` characters; only rows before the cut are gathered."""
    rows = in_range(units, spans.withColumnRenamed("grp", "grp"))
    ran = scan(rows, ["span_id"], ["pos"], {"_len": ("sum", F.length("text") + len(sep))}, before_only=True)
    need = ran.filter(F.coalesce("_len", F.lit(0)) <= cap)
    joined = need.groupBy("span_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), sep).alias("text")
    )
    return joined.withColumn("text", F.substring("text", 1, cap))


def next_token(tokens: DataFrame, unit: Sequence[str], fields: Sequence[str], order: Sequence = ("tok_no",)) -> DataFrame:
    """Fields of the following token of the unit as ``next_<field>``; equality on the next number."""
    follow = tokens.select(*unit, (F.col("tok_no") - 1).alias("tok_no"), *[F.col(f).alias(f"next_{f}") for f in fields])
    return tokens.join(follow, [*unit, "tok_no"], "left")


def child_flag(parents: DataFrame, children: DataFrame, on: Sequence[str], cond: Column, out: str) -> DataFrame:
    hit = children.filter(cond).select(*on).distinct().withColumn(out, F.lit(True))
    return parents.join(hit, list(on), "left").withColumn(out, F.coalesce(out, F.lit(False)))


# --- dictionaries -------------------------------------------------------------
def first_wins(sources: Sequence[DataFrame], form: str, value: str, order: Sequence[str]) -> DataFrame:
    """One value per form: the earliest source wins, then the earliest row."""
    rows = None
    for rank, s in enumerate(sources):
        part = s.select(form, value, F.lit(rank).alias("src"), *order)
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy(form).agg(F.min_by(F.struct(value, "src"), F.struct("src", *order, value)).alias("_b"))
    return best.select(form, F.col(f"_b.{value}").alias(value), F.col("_b.src").alias("src"))


def form_variants(c: Column, preset: str = "forms") -> Column:
    """Skeletons of a form with and without its article, of two letters or more."""
    both = F.array(tx.fold(c, preset), tx.fold(F.regexp_replace(c, "^[وفبكل]?ال", ""), preset))
    return F.filter(F.array_distinct(both), lambda x: F.length(x) >= 2)


def dictionary_join(keys: DataFrame, entries: DataFrame, variants: Column) -> DataFrame:
    """First spelling of each key that a source knows: (key, source, matched, text).

    ``entries`` has (source, word, text, seq); the first entry of a word counts.
    """
    known = entries.filter((F.col("word") != "") & F.col("text").isNotNull()).groupBy("source", "word").agg(F.min_by("text", "seq").alias("text"))
    cand = keys.select("key", F.posexplode(variants).alias("_p", "word"))
    hit = cand.join(known, "word").groupBy("key", "source").agg(F.min_by(F.struct("word", "text"), "_p").alias("_m"))
    return hit.select("key", "source", F.col("_m.word").alias("matched"), F.col("_m.text").alias("text"))


def coverage(matches: DataFrame, keys: DataFrame) -> DataFrame:
    """(source, hits, total) of a dictionary join."""
    total = keys.agg(F.countDistinct("key").alias("total"))
    hits = matches.groupBy("source").agg(F.countDistinct("key").alias("hits"))
    return hits.withColumn("total", total.scalar())


def lexicon_concat(entries: DataFrame, key: Column, text: Column, order: Sequence[str], size: int = 1000, sep: str = "\n\n") -> DataFrame:
    """Texts of one normalised key joined in order, in parts of bounded length."""
    rows = entries.select(key.alias("key"), text.alias("text"), *order).filter("key <> '' AND text IS NOT NULL")
    parts = collect_chunked(rows, ["key"], [*order, "text"], {"texts": F.col("text")}, size)
    return parts.select("key", "part", F.array_join("texts", sep).alias("text"))


def anchor_headwords(words: DataFrame, keys: DataFrame, subkeys: DataFrame, stop: Sequence[str], preset: str = "quote") -> DataFrame:
    """(entry, word) → key: by the word itself, through a subkey, or without its article."""
    direct = keys.select(tx.fold(F.col("key"), preset).alias("skel"), "key", F.lit(0).alias("via"))
    indirect = subkeys.select(tx.fold(F.col("subkey"), preset).alias("skel"), "key", F.lit(1).alias("via"))
    index = direct.unionByName(indirect).groupBy("skel").agg(F.min_by(F.struct("key", "via"), F.struct("via", "key")).alias("_h"))
    skel = F.regexp_replace(tx.fold(F.col("word"), preset), "^و", "")
    cand = words.select("entry", "word", F.posexplode(F.array(skel, F.regexp_replace(skel, "^ال", ""))).alias("_p", "skel"))
    cand = cand.filter(~F.col("skel").isin(*stop) & (F.length("skel") >= 2))
    hit = cand.join(index, "skel").groupBy("entry", "word").agg(F.min_by("_h", "_p").alias("_h"))
    return hit.select("entry", "word", F.col("_h.key").alias("key"), F.col("_h.via").alias("via"))


def merge_annotations(rows: DataFrame, notes: DataFrame, on: str, fields: Sequence[str], force: Column | None = None) -> DataFrame:
    """Take a noted value where the row has none, or where ``force`` (on the note) says so."""
    renamed = notes.select(on, *[F.col(f).alias(f"_n_{f}") for f in fields], *( [force.alias("_force")] if force is not None else [F.lit(False).alias("_force")] ))
    out = rows.join(renamed, on, "left")
    for f in fields:
        note = F.col(f"_n_{f}")
        out = out.withColumn(f, F.when(F.col("_force") & note.isNotNull(), note).otherwise(F.coalesce(F.col(f), note)))
    return out.drop("_force", *[f"_n_{f}" for f in fields])


def units_of_key(tokens: DataFrame, key: str, unit: Sequence[str]) -> DataFrame:
    return tokens.filter(F.col("key") == key).select(*unit).distinct().orderBy(*unit)


def resolve_references(queries: DataFrame, aliases: DataFrame, divisions: DataFrame, groups: DataFrame, sizes: DataFrame, keys: DataFrame) -> DataFrame:
    """Ranked targets (query, kind, target, rank) of short references.

    Kinds, best first: alias, address ``g:a``, ``<division> n``, group name with
    a number, key, and free text as the last resort.
    """
    q = queries.select("query", tx.fold(tx.ascii_digits(F.trim("query"))).alias("norm"))
    q = q.withColumn("num", F.regexp_extract("norm", "([0-9]+)$", 1).try_cast("long"))
    q = q.withColumn("head", F.trim(F.regexp_replace("norm", "[0-9]+$", "")))
    a = q.join(aliases.select(tx.fold(F.col("alias")).alias("norm"), "target"), "norm").select("query", F.lit("alias").alias("kind"), "target", F.lit(1).alias("rank"))
    at = q.filter(F.col("norm").rlike("^[0-9]+:[0-9]+$")).select("query", tx.address_part(F.col("norm"), 0).cast("long").alias("grp"), tx.address_part(F.col("norm"), 1).cast("long").alias("pos"))
    addr = at.join(sizes, "grp").filter("pos BETWEEN 1 AND size").select("query", F.lit("address").alias("kind"), tx.address(F.col("grp"), F.col("pos")).alias("target"), F.lit(2).alias("rank"))
    div = q.join(divisions.select(tx.fold(F.col("division")).alias("head"), F.col("n").alias("num"), "target"), ["head", "num"]).select("query", F.lit("division").alias("kind"), "target", F.lit(3).alias("rank"))
    named = q.join(groups.select(tx.fold(F.col("name")).alias("head"), "grp"), "head").join(sizes, "grp")
    named = named.filter(F.col("num").isNull() | F.col("num").between(1, F.col("size")))
    grp = named.select("query", F.lit("group").alias("kind"), tx.address(F.col("grp"), F.coalesce("num", F.lit(1))).alias("target"), F.lit(4).alias("rank"))
    key = q.join(keys.select(tx.fold(F.col("key")).alias("norm"), "key").distinct(), "norm").select("query", F.lit("key").alias("kind"), F.col("key").alias("target"), F.lit(5).alias("rank"))
    text = q.select("query", F.lit("text").alias("kind"), F.col("norm").alias("target"), F.lit(6).alias("rank"))
    return a.unionByName(addr).unionByName(div).unionByName(grp).unionByName(key).unionByName(text)


def build_collections(criteria: DataFrame, tokens: DataFrame, place: Sequence[str]) -> DataFrame:
    """Units of collections defined by rows (coll, seq, kind, value): key, subkey or unit; first criterion kept."""
    hits = None
    for kind in ("key", "subkey"):
        c = criteria.filter(F.col("kind") == kind).select("coll", "seq", F.col("value").alias(kind))
        part = tokens.select(F.col(kind).cast("string").alias(kind), *place).distinct().join(c, kind).select("coll", "seq", *place)
        hits = part if hits is None else hits.unionByName(part)
    manual = criteria.filter("kind = 'unit'").select("coll", "seq", *[tx.address_part(F.col("value"), i).cast("long").alias(p) for i, p in enumerate(place)])
    hits = hits.unionByName(manual)
    return hits.groupBy("coll", *place).agg(F.min("seq").alias("seq"))


def climb_tree(nodes: DataFrame) -> DataFrame:
    """(id, top, hops) of a parent-pointer table by pointer doubling until no
    pointer moves: log2(height) rounds.  A parent that is no node is the top of
    what climbs to it; a cycle has no top and is refused."""
    at = cut_lineage(nodes.select("id", F.coalesce("parent", "id").alias("top"), F.when(F.col("parent").isNull() | (F.col("parent") == F.col("id")), 0).otherwise(1).alias("hops")))
    size = at.count()
    while True:
        up = at.select(F.col("id").alias("top"), F.col("top").alias("_t"), F.col("hops").alias("_h"))
        step = at.join(up, "top", "left")
        new = step.select("id", F.coalesce("_t", "top").alias("top"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.coalesce(F.col("_t") != F.col("top"), F.lit(False)).alias("moved"))
        new = cut_lineage(new)
        state = new.agg(F.max("moved").alias("moved"), F.max("hops").alias("hops")).first()
        at = new.drop("moved")
        if not state.moved:
            return at
        if state.hops > size:
            raise ValueError("the parents form a cycle")


def concordance(tokens: DataFrame, key: str, subkey, unit: Sequence[str], samples: int, size: int = 1000) -> DataFrame:
    """Units of a key narrowed to a subkey, with the matching token numbers, first ``samples`` units."""
    hit = tokens.filter(F.col("key") == key)
    if subkey is not None:
        hit = hit.filter(F.col("subkey") == subkey)
    counted = hit.groupBy(*unit).agg(F.count(F.lit(1)).alias("n")).orderBy(*unit).limit(samples)
    parts = collect_chunked(hit.join(counted, list(unit)), unit, ["tok_no"], {"at": F.col("tok_no")}, size)
    return parts.select(*unit, "part", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("at"))


def lexicons_with(keys: DataFrame, entries: DataFrame, preset: str = "lexicon") -> DataFrame:
    """(key, source) pairs: which lexicons hold a key."""
    e = entries.select("source", tx.fold(F.col("word"), preset).alias("skel")).distinct()
    return keys.select("key", tx.fold(F.col("key"), preset).alias("skel")).join(e, "skel").select("key", "source").distinct()


def lexicon_text(key: str, source: str, entries: DataFrame, preset: str = "lexicon") -> DataFrame:
    return entries.filter((F.col("source") == source) & (tx.fold(F.col("word"), preset) == tx.fold(F.lit(key), preset))).orderBy("seq")


def top_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


