"""Segmentation of ordered units, eligibility rules, scores and tiers.

A gap (grp, pos) stands between unit ``pos`` and ``pos + 1`` of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.scale import cut_lineage, neighbours, scan, top_k
from corpusloom.operators.model import in_range
from corpusloom.operators.vectors import dot, normalise


def _side(near: str, offsets: Sequence[int], field: str) -> Column:
    """Array of a field over present neighbours."""
    return F.array_compact(F.array(*[F.col(near)[F.lit(o)][field] for o in offsets]))


def _mean(vs: Column, size: int) -> Column:
    zero = F.array_repeat(F.lit(0.0), size)
    return normalise(F.aggregate(vs, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)))


def gap_similarity(units: DataFrame, dim: int, width: int = 2) -> DataFrame:
    """(grp, pos, sim): cosine of the mean vectors of ``width`` units on both sides of each gap."""
    near = neighbours(units.select("grp", "pos", "vec"), ["grp"], ["pos"], ["vec"], width - 1, width)
    near = near.filter(F.col("near")[F.lit(1)].isNotNull())
    near = near.withColumns({"_l": _side("near", range(1 - width, 1), "vec"), "_r": _side("near", range(1, width + 1), "vec")})
    near = near.withColumns({"_l": _mean(F.col("_l"), dim), "_r": _mean(F.col("_r"), dim)})
    return near.select("grp", "pos", F.round(dot("_l", "_r"), 9).alias("sim"))


def texttiling_depth(gaps: DataFrame) -> DataFrame:
    """Add ``depth``: how far the similarity climbs without a break to the left and to the right.

    A climb to the left ends at the last gap whose left neighbour is lower, so
    the peak is the start of a run; both runs come from ordered scans.
    """
    near = neighbours(gaps.select("grp", "pos", "sim"), ["grp"], ["pos"], ["sim"], 1, 1)
    prev, nxt = F.col("near")[F.lit(-1)]["sim"], F.col("near")[F.lit(1)]["sim"]
    f = cut_lineage(near.select("grp", "pos", "sim", F.when(prev >= F.col("sim"), 0).otherwise(1).alias("nl"), F.when(nxt >= F.col("sim"), 0).otherwise(1).alias("nr")))
    left = scan(f, ["grp"], ["pos"], {"lrun": ("sum", F.col("nl"))}).select("grp", "pos", "lrun")
    right = scan(f, ["grp"], [F.desc("pos")], {"rrun": ("sum", F.col("nr"))}).select("grp", "pos", "rrun")
    both = cut_lineage(f.join(left, ["grp", "pos"]).join(right, ["grp", "pos"]))
    # going left the values never fall inside a run, so the peak is the run's first value
    lp = both.groupBy("grp", "lrun").agg(F.max("sim").alias("lp"))
    rp = both.groupBy("grp", "rrun").agg(F.max("sim").alias("rp"))
    out = both.join(lp, ["grp", "lrun"]).join(rp, ["grp", "rrun"])
    return out.select("grp", "pos", "sim", (F.col("lp") + F.col("rp") - 2 * F.col("sim")).alias("depth"))


def vocabulary_break(units: DataFrame, width: int = 2, least: int = 4) -> DataFrame:
    """(grp, pos, brk): 1 minus the containment of key sets around each gap; 0 without enough keys.

    ``units`` has (grp, pos, keys): the unit's distinct keys, stop keys removed.
    """
    near = neighbours(units.select("grp", "pos", "keys"), ["grp"], ["pos"], ["keys"], width - 1, width)
    near = near.filter(F.col("near")[F.lit(1)].isNotNull())
    near = near.withColumns({
        "_l": F.array_distinct(F.flatten(_side("near", range(1 - width, 1), "keys"))),
        "_r": F.array_distinct(F.flatten(_side("near", range(1, width + 1), "keys"))),
    })
    small = F.least(F.size("_l"), F.size("_r"))
    b = F.when(small >= least, 1 - F.size(F.array_intersect("_l", "_r")) / small).otherwise(F.lit(0.0))
    return near.select("grp", "pos", b.alias("brk"))


def category_shift(units: DataFrame, width: int = 2, support: int = 3) -> DataFrame:
    """(grp, pos, shift): half the change of the shares of categories 2 and 3 of three.

    ``units`` has counts (c1, c2, c3).  The adjacent unit speaks for its side
    when it has any count, else the whole window; under ``support`` counts
    there is no shift.
    """
    c = ["c1", "c2", "c3"]
    near = neighbours(units.select("grp", "pos", *c), ["grp"], ["pos"], c, width - 1, width)
    near = near.filter(F.col("near")[F.lit(1)].isNotNull())

    def total(offsets, field):
        return sum((F.coalesce(F.col("near")[F.lit(o)][field], F.lit(0)) for o in offsets[1:]), F.coalesce(F.col("near")[F.lit(offsets[0])][field], F.lit(0)))

    def sides(first, window):
        own = sum((total([first], x) for x in c[1:]), total([first], c[0]))
        return {x: F.when(own > 0, total([first], x)).otherwise(total(window, x)) for x in c}

    l, r = sides(0, list(range(0, -width, -1))), sides(1, list(range(1, width + 1)))
    near = near.withColumns({f"l{x}": v for x, v in l.items()}).withColumns({f"r{x}": v for x, v in r.items()})
    lt, rt = F.expr("lc1 + lc2 + lc3"), F.expr("rc1 + rc2 + rc3")
    d = lambda x: F.abs(F.col(f"l{x}") / lt - F.col(f"r{x}") / rt)
    shift = F.when((lt >= support) & (rt >= support), (d("c2") + d("c3")) / 2).otherwise(F.lit(0.0))
    return near.select("grp", "pos", shift.alias("shift"))


def ending_change(units: DataFrame) -> DataFrame:
    """(grp, pos, ending_shift): the ending changes here and is stable on both sides."""
    near = neighbours(units.select("grp", "pos", "ending"), ["grp"], ["pos"], ["ending"], 1, 2)
    at = lambda o: F.col("near")[F.lit(o)]["ending"]
    near = near.filter(F.col("near")[F.lit(1)].isNotNull())
    cond = (at(0) != at(1)) & (at(-1).isNull() | (at(-1) == at(0))) & (at(2).isNull() | (at(1) == at(2)))
    return near.select("grp", "pos", cond.cast("int").alias("ending_shift"))


def surface_cues(units: DataFrame, openers: dict[str, Sequence[str]], closers: dict[str, Sequence[str]], patterns: dict[str, str]) -> DataFrame:
    """Cue flags of each gap: how the next unit opens, how this one ends, patterns on the next."""
    near = neighbours(units.select("grp", "pos", "text"), ["grp"], ["pos"], ["text"], 0, 1)
    near = near.filter(F.col("near")[F.lit(1)].isNotNull()).select("grp", "pos", F.col("near")[F.lit(0)]["text"].alias("prev"), F.col("near")[F.lit(1)]["text"].alias("next"))
    cues = {k: tx.starts_with_any(F.col("next"), v) for k, v in openers.items()}
    cues |= {k: tx.tail_has_any(F.col("prev"), v) for k, v in closers.items()}
    cues |= {k: F.col("next").rlike(v) for k, v in patterns.items()}
    return near.select("grp", "pos", *[v.cast("int").alias(k) for k, v in cues.items()])


# Rank shares below which a gap is a boundary or open.
BOUNDARY_SHARE, OPEN_SHARE = 0.09, 0.43


def classify_gaps(gaps: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted score and class boundary / gray / continuation by the scores at two ranks."""
    from corpusloom.operators.stats import index_quantiles

    score = sum((w * F.col(c) for c, w in list(weights.items())[1:]), list(weights.values())[0] * F.col(list(weights)[0]))
    g = cut_lineage(gaps.withColumn("score", F.round(score, 6)))
    n = g.count()
    neg = g.select((-F.col("score")).alias("v"))
    # place floor(n*share) of the descending order is an exact index
    at = [min(1.0, (int(n * s) + 1e-9) / max(1, n - 1)) for s in (BOUNDARY_SHARE, OPEN_SHARE)]
    q = index_quantiles(neg, "v", at).agg(F.struct((-F.min("value")).alias("hi"), (-F.max("value")).alias("lo")))
    g = g.withColumn("_q", q.scalar())
    cls = F.when(F.col("score") >= F.col("_q.hi"), "boundary").when(F.col("score") >= F.col("_q.lo"), "gray").otherwise("continuation")
    return g.withColumn("cls", cls).drop("_q")


def decide_gaps(gaps: DataFrame, verdicts: DataFrame, unsure: str = "cont") -> DataFrame:
    """Add ``is_boundary``: the class, or for gray gaps the verdict; an unsure gap
    continues, or follows the sign of its score under ``unsure='seed'``."""
    g = gaps.join(verdicts.select("grp", "pos", "verdict"), ["grp", "pos"], "left")
    undecided = F.col("score") >= 0 if unsure == "seed" else F.lit(False)
    is_b = (
        F.when(F.col("cls") == "boundary", True)
        .when(F.col("cls") == "continuation", False)
        .when(F.col("verdict") == "boundary", True)
        .when(F.col("verdict") == "continuation", False)
        .otherwise(undecided)
    )
    return g.withColumn("is_boundary", is_b)


def spans_from_boundaries(units: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(grp, first, last): runs of units between boundaries, covering each group."""
    b = boundaries.select("grp", (F.col("pos") + 1).alias("pos"), F.lit(1).alias("_b"))
    f = units.select("grp", "pos").join(b, ["grp", "pos"], "left").withColumn("_b", F.coalesce("_b", F.lit(0)))
    run = scan(f, ["grp"], ["pos"], {"_s": ("sum", F.col("_b"))})
    return run.groupBy("grp", "_s").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("_s")


def boundary_agreement(gaps: DataFrame, starts: DataFrame) -> DataFrame:
    """Per class and reference: share of gaps followed by a reference start.

    ``starts`` has (reference, grp, pos)."""
    hit = gaps.select("cls", "grp", (F.col("pos") + 1).alias("pos")).join(starts, ["grp", "pos"]).groupBy("cls", "reference").agg(F.count(F.lit(1)).alias("hits"))
    n = gaps.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    refs = starts.select("reference").distinct().agg(F.collect_set("reference"))
    grid = n.withColumn("reference", F.explode(refs.scalar()))
    return grid.join(hit, ["cls", "reference"], "left").select("cls", "reference", "n", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 3).alias("share"))


# --- eligibility rules ----------------------------------------------------------------
class Rule:
    """One gate or blocker over token tags.

    ``head`` must hold on a token; ``then`` on one of the next ``within``
    tokens of the clause, with no token before it on which ``unless`` holds.
    ``first`` limits the head to the first tokens of the clause.
    """

    def __init__(self, name: str, head: Column, then: Column | None = None, within: int = 3, unless: Column | None = None, first: int | None = None):
        self.name, self.head, self.then, self.within, self.unless, self.first = name, head, then, within, unless, first


def clause_gates(tokens: DataFrame, clauses: DataFrame, gates: Sequence[Rule], blockers: Sequence[Rule], frame: Sequence[Rule], inherits: Column) -> DataFrame:
    """(grp, pos, clause, gates, blockers, qualified) by a table of rules.

    ``tokens`` has (grp, pos, tok_no, ...tag columns), ``clauses`` (grp, pos,
    clause, first, last).  A frame rule met anywhere in a unit blocks all of
    its clauses.  A clause whose first token meets ``inherits`` also carries
    the local blockers of the clause before it.
    """
    t = tokens.join(clauses.withColumn("tok_no", F.explode(F.sequence("first", "last"))), ["grp", "pos", "tok_no"])
    rules = [*gates, *blockers, *frame]
    marks = {f"h{i}": r.head & ((F.col("tok_no") < F.col("first") + r.first) if r.first else F.lit(True)) for i, r in enumerate(rules)}
    marks |= {f"t{i}": r.then for i, r in enumerate(rules) if r.then is not None}
    marks |= {f"u{i}": r.unless for i, r in enumerate(rules) if r.unless is not None}
    flat = t.select("grp", "pos", "clause", "tok_no", "first", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in marks.items()], F.coalesce(inherits, F.lit(False)).alias("inh"))
    flat = cut_lineage(flat)
    look = sorted({k for k in marks if k[0] in "tu"})
    reach = max([r.within for r in rules if r.then is not None], default=0)
    if look:
        far = flat.select("grp", "pos", "clause", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("d"), "tok_no", F.struct(*look).alias("s"))
        far = far.withColumn("tok_no", F.col("tok_no") - F.col("d"))
        ahead = far.groupBy("grp", "pos", "clause", "tok_no").agg(F.map_from_entries(F.collect_list(F.struct("d", "s"))).alias("near"))
        flat = flat.join(ahead, ["grp", "pos", "clause", "tok_no"], "left")

    def fires(i, r):
        head = F.col(f"h{i}")
        if r.then is None:
            return head
        hit = F.lit(False)
        for d in range(r.within, 0, -1):
            s = F.col("near")[F.lit(d)]
            here = F.coalesce(s[f"t{i}"], F.lit(False))
            stop = F.coalesce(s[f"u{i}"], F.lit(False)) if r.unless is not None else F.lit(False)
            hit = here | (~stop & hit)
        return head & hit

    kinds = ["gate"] * len(gates) + ["blocker"] * len(blockers) + ["frame"] * len(frame)
    names = lambda kind: F.array_compact(F.array(*[F.when(fires(i, r), F.lit(r.name)) for i, (r, k) in enumerate(zip(rules, kinds)) if k == kind], F.lit(None).cast("string")))
    told = flat.select("grp", "pos", "clause", ((F.col("tok_no") == F.col("first")) & F.col("inh")).alias("inh"), names("gate").alias("g"), names("blocker").alias("b"), names("frame").alias("f"))
    # the sets are bounded by the number of rules, however long the clause
    flags = told.groupBy("grp", "pos", "clause").agg(
        F.bool_or("inh").alias("inh"), *[F.bool_or(F.array_contains("g", r.name)).alias(f"g_{i}") for i, r in enumerate(gates)],
        *[F.bool_or(F.array_contains("b", r.name)).alias(f"b_{i}") for i, r in enumerate(blockers)], *[F.bool_or(F.array_contains("f", r.name)).alias(f"f_{i}") for i, r in enumerate(frame)],
    )
    pick = lambda p, rs: F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"{p}_{i}"), F.lit(r.name)) for i, r in enumerate(rs)], F.lit(None).cast("string"))))
    c = cut_lineage(flags.select("grp", "pos", "clause", F.coalesce("inh", F.lit(False)).alias("inh"), pick("g", gates).alias("gates"), pick("b", blockers).alias("own"), pick("f", frame).alias("fr")))
    unit = c.select("grp", "pos", F.explode("fr").alias("r")).groupBy("grp", "pos").agg(F.array_sort(F.collect_set("r")).alias("frame"))
    # a chain of inheriting clauses shares its blockers forward; chains start where inheritance stops
    chain = cut_lineage(scan(c, ["grp", "pos"], ["clause"], {"chain": ("sum", F.when(F.col("inh"), 0).otherwise(1))}))
    held = chain.select("grp", "pos", "chain", "clause", F.explode("own").alias("r")).groupBy("grp", "pos", "chain", "r").agg(F.min("clause").alias("since"))
    carried = chain.select("grp", "pos", "chain", "clause").join(held, ["grp", "pos", "chain"]).filter("since <= clause").groupBy("grp", "pos", "clause").agg(F.collect_set("r").alias("local"))
    out = chain.join(carried, ["grp", "pos", "clause"], "left").join(unit, ["grp", "pos"], "left")
    none = F.array().cast("array<string>")
    blocked = F.array_sort(F.array_union(F.coalesce("local", none), F.coalesce("frame", none)))
    return out.select("grp", "pos", "clause", "gates", blocked.alias("blockers"), ((F.size("gates") > 0) & (F.size(blocked) == 0)).alias("qualified"))


# --- scores and tiers -------------------------------------------------------------------
def composite_score(df: DataFrame, key: str, weights: dict[str, float], inverted: Sequence[str] = ()) -> DataFrame:
    """Weighted sum of place percentiles (1 - p for inverted signals)."""
    from corpusloom.operators.stats import position_percentile

    out = df
    for c in weights:
        out = out.join(position_percentile(df.select(key, c), c, key, f"{c}_p").select(key, f"{c}_p"), key)
    parts = [w * ((1 - F.col(f"{c}_p")) if c in inverted else F.col(f"{c}_p")) for c, w in weights.items()]
    return out.withColumn("score", F.round(sum(parts[1:], parts[0]), 9))


def global_tiers(scored: DataFrame, key: str, top: float, inner: float) -> DataFrame:
    """tier 0 / 1 / 2 by the percentile of the score over all rows."""
    from corpusloom.operators.stats import position_percentile

    p = position_percentile(scored, "score", key, "place")
    return p.withColumn("tier", F.when(F.col("place") >= top, 0).when(F.col("place") >= inner, 1).otherwise(2))


def best_unit(units: DataFrame, parent: str, order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    return units.groupBy(parent).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("b")).select(parent, *[F.col(f"b.{f}").alias(f) for f in fields])


def threshold_tier(spread: Column, links: Column, t: Column, m: Column) -> Column:
    return F.when(spread >= t, 0).when(links >= m, 1).otherwise(2)


def majority_cluster(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """(dst, cluster): the cluster most sources of a target belong to; ties to the smaller id."""
    n = links.join(clusters.withColumnRenamed("id", "src"), "src").groupBy("dst", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("dst").agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("cluster"))


def tag_spans(spans: DataFrame, votes: DataFrame, share: float = 0.6) -> DataFrame:
    """(span_id, rank, label, votes): the label with the most votes, and a second with
    at least ``share`` of them.  ``votes`` has (grp, pos, label, v)."""
    v = in_range(votes, spans).groupBy("span_id", "label").agg(F.sum("v").alias("votes"))
    two = top_k(v, ["span_id"], [F.desc("votes"), "label"], 2, "rank")
    best = v.groupBy("span_id").agg(F.max("votes").alias("_m"))
    return two.join(best, "span_id").filter((F.col("rank") == 1) | (F.col("votes") >= share * F.col("_m"))).select("span_id", F.col("rank").cast("long").alias("rank"), "label", "votes")


def display_score(links: Column, spread: Column, mutual: Column) -> Column:
    return F.least(F.lit(1.0), (2 * links + 4 * spread + 2 * mutual) / 60)


def select_clauses(rows: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Qualified clauses of a unit, or the whole unit where none qualifies (clause 0 is the whole)."""
    has = rows.filter("clause > 0 AND qualified").select(*unit).distinct()
    whole = rows.filter("clause = 0 AND qualified").join(has, list(unit), "left_anti")
    return rows.filter("clause > 0 AND qualified").unionByName(whole)


