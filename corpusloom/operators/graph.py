"""Graphs as edge tables: centrality, components, communities, trees, evidence networks.

Directed edges are (src, dst, w); undirected ones (a, b, w) with a < b.
Rounds end in a checkpoint so that lineage stays short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.scale import cut_lineage, forget, kept, ordinal, pairs_within, scratch_path, top_k


def two_ways(a: str, b: str, *rest: str):
    """Explode an undirected edge into both directions (node, other, ...)."""
    return F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other"), *rest), F.struct(F.col(b).alias("node"), F.col(a).alias("other"), *rest)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node id reachable over undirected edges.

    Every node points to a smaller one of its component.  In a round the smallest
    grandparent among its neighbours becomes the parent of the node and of its
    own parent, so that whole trees are hooked at their roots, and paths are
    halved: the rounds grow with the logarithm of a chain, however its ids lie.
    """
    both = kept(edges.select(two_ways("src", "dst").alias("x")).select("x.*").distinct(), "both-ways")
    up = kept(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("up"), F.col("node").alias("was")), "parents")
    while True:  # every round lowers a parent or ends
        grand = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        label = kept(up.join(grand, "up").select("node", "up", "top"), "grandparents")
        forget(up)
        near = both.join(label.select(F.col("node").alias("other"), "top"), "other").groupBy("node").agg(F.min("top").alias("near"))
        ways = F.array(F.struct("node", F.least("top", "near").alias("to"), F.col("up").alias("was")), F.struct(F.col("up").alias("node"), F.col("near").alias("to"), F.lit(None).cast(label.schema["up"].dataType).alias("was")))
        hooked = label.join(near, "node").select(F.explode(ways).alias("x")).select("x.*")
        up = kept(hooked.groupBy("node").agg(F.min("to").alias("up"), F.min("was").alias("was")), "parents")
        forget(label)
        if up.filter("up <> was").isEmpty():
            forget(both)
            return up.select("node", F.col("up").alias("component"))


def giant_share(comp: DataFrame) -> DataFrame:
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return size.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("giant"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def orient(und: DataFrame, generality: DataFrame) -> DataFrame:
    """Edges from the less to the more general end; a tie points to the smaller id."""
    g = generality.select("id", F.round("generality", 9).alias("g"))
    e = und.join(g.withColumnsRenamed({"id": "a", "g": "_ga"}), "a").join(g.withColumnsRenamed({"id": "b", "g": "_gb"}), "b")
    up = F.col("_ga") >= F.col("_gb")
    return e.select(F.when(up, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("dst"), "w")


def undirected(directed: DataFrame) -> DataFrame:
    """One row per unordered pair with its best weight."""
    return directed.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 40) -> DataFrame:
    """(node, rank): weighted PageRank; the mass of dead ends is shared by all nodes.

    Teleport and dead ends only ever add the same amount to every node, so
    the ranks are a weighted sum of u0 = 1, u1 = d·P·u0, u2 = d·P·u1, ...
    Each u is one join and one partial sum over the edges; nodes nothing
    flows to need no row, and the weights come from the totals of the u's.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("_o"))
    share = cut_lineage(edges.join(out, "src").select("src", "dst", (damping * F.col("w") / F.col("_o")).alias("p")))
    u = cut_lineage(nodes.select("node").distinct().withColumn("u", F.lit(1.0)))
    terms = [u]
    for _ in range(rounds):
        step = share.join(u.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("u")).alias("u"))
        u = cut_lineage(step)
        terms.append(u)
    rows = None
    for k, t in enumerate(terms):
        part = t.select("node", "u", F.lit(k).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    sums = {r["k"]: r["s"] for r in rows.groupBy("k").agg(F.sum("u").alias("s")).collect()}  # one row per round
    n = sums[0]
    coef = [1.0 / n]  # weight of u0, u1, ... in the current ranks
    for _ in range(rounds):
        kept = sum(c * sums.get(k + 1, 0.0) for k, c in enumerate(coef))
        coef = [(1.0 - kept) / n, *coef]
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in coef]), F.col("k") + 1)
    return rows.groupBy("node").agg(F.sum(F.col("u") * weight).alias("rank"))


def hits(nodes: DataFrame, edges: DataFrame, rounds: int = 30, keep: int = 5) -> DataFrame:
    """(node, authority, hub), both of unit length.

    Scaling does not change directions, so lengths are only set every
    ``keep`` rounds, when the scores are checkpointed anyway.
    """
    e = cut_lineage(edges.select("src", "dst", "w"))

    def unit(df, c):
        df = cut_lineage(df)
        size = df.agg(F.sqrt(F.sum(F.col(c) * F.col(c)))).first()[0] or 1.0
        return df.withColumn(c, F.col(c) / size)

    h = nodes.select("node").distinct().withColumn("hub", F.lit(1.0))
    for i in range(rounds):
        a = e.join(h.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("hub") * F.col("w")).alias("authority"))
        if i == rounds - 1:
            a = unit(a, "authority")
        h = e.join(a.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("authority") * F.col("w")).alias("hub"))
        if i % keep == keep - 1 or i == rounds - 1:
            h = unit(h, "hub")
    return nodes.select("node").distinct().join(a, "node", "left").join(h, "node", "left").fillna(0.0, ["authority", "hub"])


def rank_fusion(scores: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sum of the places a node has under every score (best = 1, ties by node)."""
    out = scores.select("node")
    for c in cols:
        placed = ordinal(scores.select("node", c), [F.desc(c), "node"], out=f"r_{c}").select("node", f"r_{c}")
        out = out.join(placed, "node")
    return out.withColumn("fused", sum((F.col(f"r_{c}") for c in cols[1:]), F.col(f"r_{cols[0]}")))


def central_nodes(edges: DataFrame, knn: DataFrame, place: DataFrame) -> DataFrame:
    """(grp, node, score): in-strength inside the group plus half the neighbour strength."""
    g = place.select("id", "grp")
    inner = edges.join(g.withColumnsRenamed({"id": "src", "grp": "_s"}), "src").join(g.withColumnsRenamed({"id": "dst", "grp": "grp"}), "dst").filter("_s = grp")
    near = knn.join(g.withColumnsRenamed({"id": "other", "grp": "_o"}), "other").join(g, "id").filter("_o = grp")
    parts = inner.select(F.col("dst").alias("node"), "grp", F.col("w").alias("s")).unionByName(near.select(F.col("id").alias("node"), "grp", (F.col("score") * 0.5).alias("s")))
    parts = parts.unionByName(place.select(F.col("id").alias("node"), "grp", F.lit(0.0).alias("s")))
    total = parts.groupBy("grp", "node").agg(F.round(F.sum("s"), 8).alias("score"))
    best = total.groupBy("grp").agg(F.min_by(F.struct("node", "score"), F.struct(-F.col("score"), F.col("node"))).alias("b"))
    return best.select("grp", "b.node", "b.score")


# --- authority variants -----------------------------------------------------------
def damped_flow(prior: DataFrame, edges: DataFrame, alpha: float = 0.35, rounds: int = 40, keep: int = 8) -> DataFrame:
    """(node, score): prior plus a damped share of the scores that point here."""
    out = edges.groupBy("src").agg(F.sum("w").alias("_o")).filter("_o > 0")
    share = cut_lineage(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("_o")).alias("p")))
    base = cut_lineage(prior.select("node", "prior"))
    state = base.select("node", F.col("prior").alias("score"))
    for i in range(rounds):
        flow = share.join(state.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("f"))
        state = base.join(flow, "node", "left").select("node", (F.col("prior") + alpha * F.coalesce("f", F.lit(0.0))).alias("score"))
        if i % keep == keep - 1 or i == rounds - 1:
            state = cut_lineage(state)
    return state


def contained_edges(surprise: DataFrame, ds: DataFrame, floor: float, margin: float) -> DataFrame:
    """Directed edges (src, dst, w, c, cos) from containment asymmetry.

    ``surprise`` has (a, b, cos, f, c_ab, c_ba).  A clear one-sided
    containment directs the edge to the contained side; otherwise both
    eligible sides share it by the square of their diversity.
    """
    d = ds.select("node", "ds")
    e = surprise.join(d.withColumnsRenamed({"node": "a", "ds": "_da"}), "a", "left").join(d.withColumnsRenamed({"node": "b", "ds": "_db"}), "b", "left")
    e = e.fillna(0.0, ["_da", "_db"])
    ok_a, ok_b = F.coalesce(F.col("c_ab") >= floor, F.lit(False)), F.coalesce(F.col("c_ba") >= floor, F.lit(False))
    clear_a = ok_a & (F.col("c_ba").isNull() | (F.round(F.col("c_ab") - F.col("c_ba"), 9) >= margin))
    clear_b = ~clear_a & ok_b & (F.col("c_ab").isNull() | (F.round(F.col("c_ba") - F.col("c_ab"), 9) >= margin))
    sq = lambda c: F.col(c) * F.col(c)
    total = sq("_da") + sq("_db")
    part_a = sq("_da") / F.when(total == 0, F.lit(1.0)).otherwise(total)
    wa, wb = F.col("f") * (0.5 + 0.5 * F.col("c_ab")), F.col("f") * (0.5 + 0.5 * F.col("c_ba"))
    to_a = F.when(clear_a, wa).when(~clear_b & ok_a, wa * part_a)
    to_b = F.when(clear_b, wb).when(~clear_a & ok_b, wb * (1 - part_a))
    ways = F.array(
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), to_a.alias("w"), F.col("c_ab").alias("c"), "cos"),
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), to_b.alias("w"), F.col("c_ba").alias("c"), "cos"),
    )
    return e.select(F.explode(ways).alias("x")).select("x.*").filter("w IS NOT NULL")


def soft_edges(surprise: DataFrame, ds: DataFrame) -> DataFrame:
    """Every surprise edge flows to both ends in proportion to squared diversity."""
    free = surprise.withColumns({"c_ab": F.lit(1.0), "c_ba": F.lit(1.0)})
    return contained_edges(free, ds, 0.0, 2.0).select("src", "dst", "w", "cos")


def cross_theme(edges: DataFrame, themes: DataFrame, floor: int = 2) -> DataFrame:
    """(node, span, mean_w, score): themes with at least ``floor`` strong in-links times their mean weight.

    Strong means at or above the median weight.
    """
    from corpusloom.operators.stats import index_quantiles

    e = cut_lineage(edges.select("src", "dst", F.round("w", 9).alias("w")))
    n = e.count()
    med = index_quantiles(e, "w", [min(1.0, (n // 2 + 1e-9) / max(1, n - 1))]).select("value")
    strong = e.withColumn("_m", med.scalar()).filter("w >= _m").join(themes.withColumnsRenamed({"id": "src"}), "src")
    per = strong.groupBy(F.col("dst").alias("node"), "theme").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"))
    out = per.groupBy("node").agg(F.count(F.when(F.col("n") >= floor, 1)).alias("span"), (F.sum("s") / F.sum("n")).alias("mean_w"))
    return out.withColumn("score", F.col("span") * F.col("mean_w"))


def diversity_parts(edges: DataFrame, vecs: DataFrame, place: DataFrame, rare: DataFrame) -> DataFrame:
    """Per node: in-strength, dispersion of the linking vectors, effective groups and rare keys per link.

    Mean pair cosine comes from the length of the sum vector; no pairs.  A node
    with fewer than three links has no row, so its vectors are not sent.
    """
    from corpusloom.operators.stats import effective_number
    from corpusloom.operators.vectors import dot, whole_sums

    base = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("strength"), F.count(F.lit(1)).alias("n"))
    src = edges.select(F.col("dst").alias("node"), F.col("src").alias("id"))
    linked = src.join(base.filter("n >= 3").select("node"), "node", "left_semi")
    sums = whole_sums(linked, vecs, "node").select("node", dot("sum", "sum").alias("sq"))
    grp = effective_number(src.join(place.select("id", "grp"), "id").groupBy("node", "grp").agg(F.count(F.lit(1)).alias("n")), ["node"]).select("node", F.col("effective").alias("eff_groups"))
    keys = effective_number(src.join(rare.select("id", "key"), "id").groupBy("node", "key").agg(F.count(F.lit(1)).alias("n")), ["node"]).select("node", F.col("effective").alias("eff_keys"), F.col("total").alias("keys"))
    out = base.filter("n >= 3").join(sums, "node").join(grp, "node", "left").join(keys, "node", "left")
    return out.select(
        "node", "n", "strength",
        F.greatest(F.lit(0.0), 1 - (F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("dispersion"),
        (F.coalesce("eff_groups", F.lit(0.0)) / F.col("n")).alias("group_ratio"),
        F.coalesce(F.col("eff_keys") / F.col("keys"), F.lit(0.0)).alias("key_ratio"),
    )


# Exponents tried for dispersion, group ratio and key ratio.
EXPONENTS = [("A", 1.0, 1.0, 1.0), ("B", 1.0, 0.5, 0.5), ("C", 1.5, 0.75, 0.75), ("D", 2.0, 1.0, 1.0), ("E", 1.0, 0.0, 1.0), ("F", 0.0, 0.5, 0.5)]


def diversity_authority(parts: DataFrame, vecs: DataFrame, most: int = 30, high: float = 0.7, min_degree: int = 8) -> tuple[DataFrame, DataFrame]:
    """Scores under every exponent setting, and per setting the redundancy of its
    leading nodes; the eligible setting with the least redundancy is marked."""
    from corpusloom.operators.vectors import dot

    combos = F.array(*[F.struct(F.lit(n).alias("combo"), F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(g).alias("z")) for n, a, b, g in EXPONENTS])
    s = parts.select("node", "n", "strength", "dispersion", "group_ratio", "key_ratio", F.explode(combos).alias("c"))
    scored = s.select("node", "n", "c.combo", F.round(F.col("strength") * F.pow("dispersion", "c.x") * F.pow("group_ratio", "c.y") * F.pow("key_ratio", "c.z"), 9).alias("score"))
    lead = cut_lineage(top_k(scored, ["combo"], [F.desc("score"), "node"], most))
    v = lead.join(vecs.select(F.col("id").alias("node"), "vec"), "node")
    # at most ``most`` rows per setting, so these pairs are few
    pair = v.select("combo", F.col("node").alias("a"), F.col("vec").alias("va")).join(v.select("combo", F.col("node").alias("b"), F.col("vec").alias("vb")), "combo").filter("a < b")
    red = pair.select("combo", dot("va", "vb").alias("cos")).groupBy("combo").agg(F.avg("cos").alias("mean_cos"), F.avg((F.col("cos") > high).cast("int")).alias("high_share"))
    deg = lead.groupBy("combo").agg(F.sort_array(F.collect_list("n")).alias("ds")).select("combo", F.element_at("ds", (F.floor(F.size("ds") / 2) + 1).cast("int")).alias("median_degree"))
    table = red.join(deg, "combo").withColumn("redundancy", F.round(F.col("mean_cos") + F.col("high_share"), 6))
    best = table.filter(F.col("median_degree") >= min_degree).agg(F.min_by("combo", F.struct("redundancy", "combo")))
    return scored, table.withColumn("chosen", F.col("combo") == best.scalar())


def length_directed(und: DataFrame, lengths: DataFrame, ratio: DataFrame, floor: float) -> DataFrame:
    """Edges into the shorter unit of a pair when the longer holds enough of its rare keys.

    ``ratio`` adds c_ab and c_ba; a unit without rare keys counts as contained.
    """
    n = lengths.select("id", "len")
    e = und.join(ratio.select("a", "b", "c_ab", "c_ba"), ["a", "b"]).join(n.withColumnsRenamed({"id": "a", "len": "_la"}), "a").join(n.withColumnsRenamed({"id": "b", "len": "_lb"}), "b").filter("_la <> _lb")
    a_short = F.col("_la") < F.col("_lb")
    c = F.coalesce(F.when(a_short, F.col("c_ab")).otherwise(F.col("c_ba")), F.lit(1.0))
    e = e.select(F.when(a_short, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(a_short, F.col("a")).otherwise(F.col("b")).alias("dst"), c.alias("c"), F.col("w").alias("cos"))
    return e.filter(F.col("c") >= floor).withColumn("w", F.col("c") * F.col("cos"))


# --- distance, reach, communities ---------------------------------------------------
def hop_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, hops) by breadth-first rounds from all sources at once over undirected edges.

    A node keeps one bit per source, 128 of them in a row, and sends only the
    bits that are new: a round moves rows per edge, not per edge and source.
    """
    both = kept(edges.select(two_ways("src", "dst").alias("x")).select("x.*").distinct(), "both-ways")
    n = F.col("_n") - 1
    named = kept(ordinal(sources.select("node").distinct(), ["node"], out="_n").select(F.col("node").alias("source"), F.floor(n / 128).alias("part"), (n % 128).cast("int").alias("bit")), "sources")
    words = ["w0", "w1"]
    one = lambda i: F.when(F.floor(F.col("bit") / 64) == i, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    seen = kept(named.select(F.col("source").alias("node"), "part", *[one(i).alias(w) for i, w in enumerate(words)]), "seen")
    spark = edges.sparkSession
    folder, hop = scratch_path(spark, "fronts"), 0
    seen.write.parquet(f"{folder}/hops=0")
    front = spark.read.schema(seen.schema).parquet(f"{folder}/hops=0")
    while not front.isEmpty():  # until no bit is new
        hop += 1
        sent = front.join(both, "node").groupBy(F.col("other").alias("node"), "part").agg(*[F.bit_or(w).alias(w) for w in words])
        known = seen.withColumnsRenamed({w: f"_{w}" for w in words})
        new = sent.join(known, ["node", "part"], "left").select("node", "part", *[F.col(w).bitwiseAND(F.bitwise_not(none(F.col(f"_{w}")))).alias(w) for w in words])
        new.filter("w0 <> 0 OR w1 <> 0").write.parquet(f"{folder}/hops={hop}")
        front = spark.read.schema(seen.schema).parquet(f"{folder}/hops={hop}")
        after = kept(seen.unionByName(front).groupBy("node", "part").agg(*[F.bit_or(w).alias(w) for w in words]), "seen")
        forget(seen)
        seen = after
    rows = spark.read.schema(T.StructType([*seen.schema, T.StructField("hops", T.IntegerType())])).parquet(folder)
    names = named.groupBy("part").agg(F.collect_list(F.struct("bit", "source")).alias("names"))
    held = lambda x: F.when(x["bit"] < 64, F.getbit("w0", x["bit"] % 64)).otherwise(F.getbit("w1", x["bit"] % 64)) == 1
    out = rows.join(names, "part").select(F.explode(F.filter("names", held)).alias("x"), "node", "hops")
    return out.select("x.source", "node", "hops")


def giant_nodes(comp: DataFrame) -> DataFrame:
    """The nodes of the largest component, of equally large ones that of the smallest name."""
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return comp.join(size.orderBy(F.desc("n"), "component").limit(1).select("component"), "component", "left_semi").select("node")


def hop_statistics(edges: DataFrame, aim: int = 120) -> DataFrame:
    """(giant, sources, mean, longest): hops between every ceil(n / aim)-th node of the
    giant component and all others of it, over undirected edges."""
    e = edges.filter("src <> dst")
    giant = kept(giant_nodes(components(e)), "giant")
    inside = e.join(giant.withColumnRenamed("node", "src"), "src", "left_semi")
    hops = hop_distances(inside, systematic_sample(giant, "node", aim)).filter("hops > 0")
    told = hops.agg(F.countDistinct("source").alias("sources"), F.avg("hops").alias("mean"), F.max("hops").alias("longest"))
    return told.select(F.lit(giant.count()).cast("long").alias("giant"), "sources", "mean", "longest")


def hop_sketches(edges: DataFrame, bits: int = 12, still: float = 1e-4) -> DataFrame:
    """(hops, pairs): about how many ordered pairs lie within each number of hops,
    from all nodes at once.  A node keeps a HyperLogLog sketch of the nodes
    within h hops, and its next one is the union of those of its neighbours;
    rounds end once the sum of all sketches grows by less than ``still``."""
    both = kept(edges.filter("src <> dst").select(two_ways("src", "dst").alias("x")).select("x.*").distinct(), "both-ways")
    own = F.hll_sketch_agg("node", F.lit(bits)).alias("sk")
    sketch = kept(both.select("node").distinct().groupBy("node").agg(own), "sketches")
    sums, last = [], float(sketch.count())
    while True:
        sent = both.join(sketch.withColumnRenamed("node", "other"), "other").select("node", "sk").unionByName(sketch)
        following = kept(sent.groupBy("node").agg(F.hll_union_agg("sk").alias("sk")), "sketches")
        total = float(following.agg(F.sum(F.hll_sketch_estimate("sk"))).first()[0] or 0)
        forget(sketch)
        sketch = following
        if total <= last * (1 + still):
            break
        sums.append((len(sums) + 1, total - last))
        last = total
    return edges.sparkSession.createDataFrame(sums, "hops int, pairs double")


def systematic_sample(nodes: DataFrame, order: str, aim: int) -> DataFrame:
    """Every ceil(n/aim)-th node in order, the first included."""
    n = nodes.count()
    step = max(1, -(-n // aim))
    return ordinal(nodes, [order], out="_rn").filter((F.col("_rn") - 1) % step == 0).drop("_rn")


def upstream_roots(links: DataFrame, vecs: DataFrame, k: int = 3) -> DataFrame:
    """(node, root, sim): the ``k`` roots nearest in meaning among those a node can climb to.

    A root has out-links and no in-links.  Roots flow down the links, one
    checkpointed round at a time.
    """
    from corpusloom.operators.vectors import dot

    e = cut_lineage(links.select("src", "dst").filter("src <> dst").distinct())
    roots = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    seen = cut_lineage(roots.select("node", F.col("node").alias("root")))
    front, hop = seen, 0
    while True:  # until no pair is new
        hop += 1
        new = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), "root").distinct().join(seen, ["node", "root"], "left_anti")
        front = cut_lineage(new)
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front)) if hop % 16 == 0 else seen.unionByName(front)
    v = vecs.select("id", "vec")
    pair = seen.filter("node <> root").join(v.withColumnsRenamed({"id": "node", "vec": "_x"}), "node").join(v.withColumnsRenamed({"id": "root", "vec": "_y"}), "root")
    return top_k(pair.select("node", "root", F.round(dot("_x", "_y"), 3).alias("sim")), ["node"], [F.desc("sim"), "root"], k)


def modularity(und: DataFrame, comm: DataFrame) -> DataFrame:
    """Modularity of a partition from two sums per community."""
    c = comm.select("node", "community")
    ends = und.select(two_ways("a", "b", "w").alias("x")).select("x.*").join(c, "node")
    deg = ends.groupBy("community").agg(F.sum("w").alias("d"))
    inner = ends.join(c.withColumnsRenamed({"node": "other", "community": "_o"}), "other").filter("_o = community").groupBy("community").agg(F.sum("w").alias("i"))
    total = und.agg((F.sum("w") * 2).cast("double"))
    per = deg.join(inner, "community", "left").withColumn("_t", total.scalar())
    return per.agg(F.sum(F.coalesce("i", F.lit(0)) / F.col("_t") - (F.col("d") / F.col("_t")) * (F.col("d") / F.col("_t"))).alias("modularity"))


def communities(und: DataFrame, rounds: int = 30, seeds: Sequence[int] = (0,)) -> DataFrame:
    """(run, node, community) of each seed, as ``local_moving`` finds them."""
    return local_moving(und, rounds, seeds)[0]


def best_communities(und: DataFrame, rounds: int = 30, seeds: Sequence[int] = range(4)) -> DataFrame:
    """(node, community) of the seed that ends with the highest modularity."""
    runs, q = local_moving(und, rounds, seeds)
    return runs.filter(F.col("run") == max(q, key=lambda r: (round(q[r], 9), -r))).select("node", "community")


def local_moving(und: DataFrame, rounds: int, seeds: Sequence[int]) -> tuple[DataFrame, dict[int, float]]:
    """(run, node, community) and the modularity of each run: local moving by gain
    until nothing moves, ``rounds`` rounds at most, once for each seed; all runs
    share their jobs.

    A round has two turns; in each, half of the active nodes (by hash of node,
    seed and round) move to the neighbouring community with the largest gain,
    ties to the smaller label.  Active are nodes that had no turn yet since they
    or a neighbour's community changed.  Modularity follows by difference: the
    inner weight from the edges of the nodes that moved, the rest from the
    totals of the communities.  Moves of one turn may hinder each other, so
    each run returns the best partition it has seen.
    """
    both = kept(und.filter("a <> b").select("a", "b", F.col("w").cast("double").alias("w")).select(two_ways("a", "b", "w").alias("x")).select("x.*"), "both-ways")
    total = both.agg(F.sum("w")).first()[0] or 1.0
    runs = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(int(s)).cast("long").alias("seed")) for r, s in enumerate(seeds)]))
    start = both.groupBy("node").agg(F.sum("w").alias("deg")).select("node", "deg", runs.alias("r"))
    state = kept(start.select("r.run", "r.seed", "node", F.col("node").alias("community"), "deg", F.lit(True).alias("active"), F.lit(0.0).alias("change")), "state")
    inner = dict.fromkeys(range(len(seeds)), 0.0)  # numbers of the driver: one per run
    best = {r: (-1.0, state) for r in inner}
    for turn in range(2 * rounds):
        has_turn = F.pmod(F.xxhash64("node", "seed", F.lit(turn // 2)), F.lit(2)) == turn % 2
        now = state.filter(F.col("active") & has_turn)
        at = state.select("run", F.col("node").alias("other"), F.col("community").alias("cand"))
        links = now.select("run", "node").join(both, "node").join(at, ["run", "other"]).groupBy("run", "node", "cand").agg(F.sum("w").alias("l"))
        links = links.unionByName(now.select("run", "node", F.col("community").alias("cand"), F.lit(0.0).alias("l"))).groupBy("run", "node", "cand").agg(F.sum("l").alias("l"))
        size = state.groupBy("run", F.col("community").alias("cand")).agg(F.sum("deg").alias("cdeg"))
        opt = links.join(now.select("run", "node", "community", "deg"), ["run", "node"]).join(size, ["run", "cand"])
        here = F.col("cand") == F.col("community")
        gain = F.round(F.col("l") - (F.col("cdeg") - F.when(here, F.col("deg")).otherwise(0.0)) * F.col("deg") / total, 9)
        pick = opt.groupBy("run", "node").agg(F.min_by("cand", F.struct(-gain, ~here, F.col("cand"))).alias("to"), F.first("community").alias("was"))
        moves = kept(pick.filter("`to` <> was"), "moves")
        # the edges of moved nodes: what they add to the inner weight, and whom they wake
        there = moves.select("run", F.col("node").alias("other"), F.col("to").alias("then"))
        seen = moves.join(both, "node").join(at, ["run", "other"]).join(there, ["run", "other"], "left")
        new = F.coalesce("then", "cand")
        # an edge between two moved nodes stands here from both ends, any other from one of two
        change = ((F.col("to") == new).cast("double") - (F.col("was") == F.col("cand")).cast("double")) * F.col("w") * F.when(F.col("then").isNull(), 2.0).otherwise(1.0)
        touched = seen.groupBy("run", F.col("other").alias("node")).agg(F.sum(change).alias("change"), F.max(F.col("to") != new).alias("woken"))
        after = state.drop("change").join(moves.select("run", "node", "to"), ["run", "node"], "left").join(touched, ["run", "node"], "left")
        active = F.coalesce("woken", F.lit(False)) | (F.col("active") & ~has_turn)
        following = kept(after.select("run", "seed", "node", F.coalesce("to", "community").alias("community"), "deg", active.alias("active"), F.coalesce("change", F.lit(0.0)).alias("change")), "state")
        totals = following.groupBy("run", "community").agg(F.sum("deg").alias("d"), F.max("active").alias("active"), F.sum("change").alias("change"))
        rows = totals.groupBy("run").agg(F.sum(F.col("d") * F.col("d")).alias("sq"), F.max("active").alias("active"), F.sum("change").alias("change")).collect()
        for r in rows:
            inner[r.run] += r.change
            q = inner[r.run] / total - r.sq / total**2
            if q > best[r.run][0] + 1e-12:
                best[r.run] = (q, following)
        forget(moves)
        if all(state is not s for _, s in best.values()):
            forget(state)
        state = following
        if not any(r.active for r in rows):
            break
    out = [s.filter(F.col("run") == r) for r, (_, s) in best.items()]
    all_runs = out[0]
    for o in out[1:]:
        all_runs = all_runs.unionByName(o)
    return all_runs.select("run", "node", "community"), {r: q for r, (q, _) in best.items()}


def partition_agreement(runs: DataFrame) -> DataFrame:
    """(agreement, pairs): on how many of all pairs of nodes the other runs agree
    with run 0 about being together, from the table of communities of run 0
    against those of each other run; no pair is formed.

    ``runs`` has (run, node, community), every node in every run.
    """
    first = runs.filter("run = 0").select("node", F.col("community").alias("c0"))
    cells = runs.filter("run > 0").join(first, "node").groupBy("run", "community", "c0").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: (F.sum(F.col(c).cast("decimal(20,0)") * (F.col(c) - 1)) / 2).cast("decimal(38,0)")
    both = cells.groupBy("run").agg(pairs("n").alias("both"), F.sum("n").alias("nodes"))
    own = cells.groupBy("run", "community").agg(F.sum("n").alias("n")).groupBy("run").agg(pairs("n").alias("own"))
    base = cells.groupBy("run", "c0").agg(F.sum("n").alias("n")).groupBy("run").agg(pairs("n").alias("base"))
    each = both.join(own, "run").join(base, "run").withColumn("all", (F.col("nodes").cast("decimal(20,0)") * (F.col("nodes") - 1) / 2).cast("decimal(38,0)"))
    agree = F.sum((F.col("all") + 2 * F.col("both") - F.col("own") - F.col("base")).cast("double"))
    return each.agg((agree / F.sum(F.col("all").cast("double"))).alias("agreement"), F.sum("all").cast("long").alias("pairs"))


def partition_stability(runs: DataFrame, nodes: DataFrame, step_a: int = 7, step_b: int = 97, shift: int = 3) -> DataFrame:
    """Share of systematic node pairs on which the runs agree with run 0 about being together.

    ``runs`` has (run, node, community).  Pair (i, j) is taken for every
    ``step_a``-th i and j = i + shift, i + shift + step_b, ...
    """
    placed = cut_lineage(ordinal(nodes.select("node").distinct(), ["node"], out="rn").withColumn("rn", F.col("rn") - 1))
    n = placed.count()
    left = placed.filter(F.col("rn") % step_a == 0).filter(F.col("rn") + shift < n)
    pair = left.select(F.col("node").alias("a"), F.explode(F.sequence(F.col("rn") + shift, F.lit(n - 1).cast("long"), F.lit(step_b).cast("long"))).alias("rn"))
    pair = pair.join(placed.withColumnRenamed("node", "b"), "rn").select("a", "b")
    r = runs.select("run", "node", "community")
    both = pair.join(r.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(r.withColumnsRenamed({"node": "b", "community": "cb"}), ["run", "b"])
    told = both.select("run", "a", "b", (F.col("ca") == F.col("cb")).alias("t"))
    cmp_ = told.filter("run > 0").join(told.filter("run = 0").select("a", "b", F.col("t").alias("t0")), ["a", "b"])
    return cmp_.agg(F.avg((F.col("t") == F.col("t0")).cast("double")).alias("stability"), F.count(F.lit(1)).alias("compared"))


def rule_projection(links: DataFrame, mutual: DataFrame, low: int = 2, high: int = 40) -> DataFrame:
    """(a, b, w) between sources: shared targets, 3 per mutual pair, 2 per direct link.

    A target reached by fewer than ``low`` or more than ``high`` sources does
    not tell sources apart and makes no pair.
    """
    l = links.select("src", "dst").distinct()
    fan = l.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(low, high))
    shared = pairs_within(l.join(fan, "dst", "left_semi"), "dst", "src").select("a", "b", F.col("n").cast("long").alias("w"))
    s = l.select("src").distinct()
    m = mutual.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    m = m.join(s.withColumnRenamed("src", "a"), "a", "left_semi").join(s.withColumnRenamed("src", "b"), "b", "left_semi")
    d = l.filter("src <> dst").join(s.withColumnRenamed("src", "dst"), "dst", "left_semi").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    every = shared.unionByName(m.select("a", "b", F.lit(3).cast("long").alias("w"))).unionByName(d.select("a", "b", F.lit(2).cast("long").alias("w")))
    return every.groupBy("a", "b").agg(F.sum("w").alias("w"))


# --- trees --------------------------------------------------------------------------
def layered_parents(nodes: DataFrame) -> DataFrame:
    """(id, parent, tier): the nearest node one tier up in the theme, else any higher
    one in the theme, else the nearest top node anywhere; inner nodes without
    children fall to the lowest tier.

    ``nodes`` has (id, theme, tier 0..2, vec), tier 0 on top.  Every question
    is a nearest-row search over the small upper tiers, scored block by block.
    """
    from corpusloom.operators.vectors import best_match

    low = nodes.filter("tier > 0").select("id", "theme", "tier", "vec")
    upper = nodes.filter("tier < 2").select("id", "theme", "tier", "vec")
    want = low.withColumn("key", F.struct("theme", (F.col("tier") - 1).alias("tier")))
    have = upper.withColumn("key", F.struct("theme", "tier"))
    first = best_match(want, have)
    # a leaf whose theme has no inner node looks at its theme's top nodes
    rest = cut_lineage(low.filter("tier = 2").join(first.select("id"), "id", "left_anti"))
    second = best_match(rest.withColumn("key", F.struct("theme", F.lit(0).alias("tier"))), have)
    done = cut_lineage(first.unionByName(second))
    left = low.join(done.select("id"), "id", "left_anti")
    third = best_match(left.withColumn("key", F.lit(0)), upper.filter("tier = 0").withColumn("key", F.lit(0)))
    parent = done.unionByName(third).select("id", F.col("other").alias("parent"))
    out = nodes.select("id", "tier").join(parent, "id", "left")
    has_child = parent.select(F.col("parent").alias("id"), F.lit(True).alias("_c")).distinct()
    return out.join(has_child, "id", "left").select("id", "parent", F.when((F.col("tier") == 1) & F.col("_c").isNull(), 2).otherwise(F.col("tier")).alias("tier"))


def examined_parents(links: DataFrame, tiers: DataFrame) -> DataFrame:
    """(node, parent): the linking node of the best tier, then most links, then smallest id."""
    cand = links.filter("src <> dst").join(tiers.select(F.col("id").alias("src"), "tier", "m"), "src").join(tiers.select(F.col("id").alias("dst")), "dst", "left_semi").filter("tier < 2")
    return cand.groupBy(F.col("dst").alias("node")).agg(F.min_by("src", F.struct("tier", -F.col("m"), "src")).alias("parent"))


def climb_to_top(parents: DataFrame, tiers: DataFrame, hops: int = 12) -> DataFrame:
    """(id, top): the top-tier node a node climbs to within ``hops`` steps, else null.

    Pointers double, so the number of joins is logarithmic in the steps; a top
    node stays where it is.
    """
    p = parents.select(F.col("node").alias("id"), "parent")
    at = tiers.select("id", "tier").join(p, "id", "left").select("id", F.when(F.col("tier") == 0, F.col("id")).otherwise(F.col("parent")).alias("at"), F.when(F.col("tier") == 0, 0).otherwise(1).alias("steps"))
    reach = 1
    while reach < hops:
        up = at.select(F.col("id").alias("at"), F.col("at").alias("_a"), F.col("steps").alias("_s"))
        at = at.join(up, "at", "left").select("id", F.col("_a").alias("at"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"))
        reach *= 2
    top = tiers.filter("tier = 0").select(F.col("id").alias("at"), F.lit(True).alias("_top"))
    return at.join(top, "at", "left").select("id", F.when(F.col("_top") & (F.col("steps") <= hops - 1), F.col("at")).alias("top"))


def child_counts(parents: DataFrame, tiers: DataFrame) -> DataFrame:
    return parents.join(tiers.select(F.col("id").alias("node"), "tier"), "node").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.when(F.col("tier") == 1, 1)).alias("inner"), F.count(F.when(F.col("tier") == 2, 1)).alias("leaves")
    )


# --- evidence networks ------------------------------------------------------------------
def union_layers(layers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(src, dst, rel, layer): the first layer that holds a link decides its relation."""
    rows = None
    for i, (name, df) in enumerate(layers):
        part = df.select("src", "dst", "rel", F.lit(name).alias("layer"), F.lit(i).alias("o"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("src", "dst").agg(F.min_by(F.struct("rel", "layer"), F.struct("o", "rel")).alias("b"))
    return best.select("src", "dst", "b.rel", "b.layer")


def mutual_links(links: DataFrame) -> DataFrame:
    """(a, b) linked both ways, each pair once."""
    l = links.select("src", "dst").filter("src <> dst").distinct()
    back = l.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return l.filter("src < dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def link_totals(links: DataFrame) -> DataFrame:
    """Directed links, mutual pairs, and links with a mutual pair counted once."""
    l = links.select("src", "dst").filter("src <> dst").distinct()
    n = l.agg(F.count(F.lit(1)).alias("directed"))
    m = mutual_links(links).agg(F.count(F.lit(1)))
    return n.withColumn("mutual", m.scalar()).withColumn("once", F.col("directed") - F.col("mutual"))


def convergence(links: DataFrame, floor: int = 2) -> DataFrame:
    return links.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("sources")).filter(F.col("sources") >= floor)


def hubs_by_relation(links: DataFrame, most: int) -> DataFrame:
    n = links.groupBy("rel", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, ["rel"], [F.desc("n"), "node"], most)


def grades(nodes: DataFrame, links: DataFrame, wide: int = 8) -> DataFrame:
    """root / branching / brief / bare from the degrees of links that were not rejected."""
    live = links.filter("review IS NULL OR review <> 'reject'")
    out = live.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    inn = live.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    g = nodes.select("node").join(out, "node", "left").join(inn, "node", "left").fillna(0, ["n_out", "n_in"])
    grade = F.when((F.col("n_out") >= wide) & (F.col("n_in") == 0), "root").when((F.col("n_out") >= 1) & (F.col("n_in") >= 1), "branching").when(F.col("n_out") >= 1, "brief").otherwise("bare")
    return g.withColumn("grade", grade)


def display_graph(knn: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    und = knn.filter(F.col("rank") <= k).groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("score").alias("w"))
    for side in ("a", "b"):
        und = und.join(nodes.select(F.col("id").alias(side), F.col("grp").alias(f"{side}_grp")), side)
    return und


def one_record(units: DataFrame, layers: Sequence[tuple[DataFrame, dict]]) -> DataFrame:
    """Units with every layer's fields by left join; missing fields take the layer's default."""
    out = units
    for df, defaults in layers:
        out = out.join(df.select("id", *defaults), "id", "left").fillna({k: v for k, v in defaults.items() if v is not None})
    return out


def null_model(links: DataFrame, themes: DataFrame, threshold: int, runs: int = 20, seed: int = 7, block: int = 4096) -> DataFrame:
    """(run, top): sources whose targets span ``threshold`` themes, for the real links
    (run 0) and for target shuffles that keep both degree sequences.

    A shuffle pairs source slots and target slots by two hash orders.  Hashes
    are even, so equal ranges of them hold about as many slots; a slot's place
    is its place in its range plus the slots of the ranges before.  Only the
    number of a slot and its theme are sent; sources and shuffled themes meet in
    blocks of ``block`` places.
    """
    l = links.select("src", "dst").join(themes.select(F.col("id").alias("dst"), "theme"), "dst", "left")
    slots = kept(ordinal(l, ["src", "dst"], out="slot").select("slot", "src", "theme"), "slots")
    real = slots.groupBy("src").agg(F.countDistinct("theme").alias("spread")).select(F.lit(0).alias("run"), "spread")
    ranges = max(1, slots.count() // (16 * block))
    h = F.xxhash64(F.lit(seed), "run", "slot")
    place = F.least(F.floor((h.cast("double") / 2.0**64 + 0.5) * ranges), F.lit(ranges - 1)).cast("int")
    every = slots.select("slot", "theme", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).withColumn("range", place)
    before = Window.partitionBy("run").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept(every.groupBy("run", "range").agg(F.count(F.lit(1)).alias("n")), "ranges").select("run", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("run", "range").orderBy(h, "slot"))
    mixed = every.withColumn("at", at).join(F.broadcast(sizes), ["run", "range"]).select("run", "range", (F.col("at") + F.col("start") - 1).alias("place"), "theme")
    in_block = F.floor(F.col("place") / block).alias("block")
    packed = mixed.groupBy("run", "range", in_block).agg(F.array_sort(F.collect_list(F.struct("place", "theme"))).alias("x"))
    packed = packed.select("run", "block", (F.col("x")[0]["place"] % block + 1).cast("int").alias("first"), F.transform("x", lambda x: x["theme"]).alias("themes"))
    sources = slots.select((F.col("slot") - 1).alias("place"), "src").groupBy(in_block).agg(F.array_sort(F.collect_list(F.struct("place", "src"))).alias("x"))
    pair = F.zip_with(F.slice(F.transform("x", lambda x: x["src"]), F.col("first"), F.size("themes")), "themes", lambda s, t: F.struct(s.alias("src"), t.alias("theme")))
    met = packed.join(sources, "block").select("run", F.explode(pair).alias("x"))
    fake = met.groupBy("run", "x.src").agg(F.size(F.collect_set("x.theme")).alias("spread")).select("run", F.col("spread").cast("long").alias("spread"))
    return real.unionByName(fake).groupBy("run").agg(F.count(F.when(F.col("spread") >= threshold, 1)).alias("top"))


def strict_roots(links: DataFrame) -> DataFrame:
    l = links.filter("src <> dst")
    return l.select(F.col("src").alias("node")).distinct().join(l.select(F.col("dst").alias("node")), "node", "left_anti")


def apply_splits(members: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace split clusters by their parts; members no part names are returned apart."""
    named = splits.select("cluster").distinct()
    same = members.join(named, "cluster", "left_anti").select("id", F.col("cluster").cast("string").alias("cluster"))
    parted = members.join(splits.select("cluster", "id", "part"), ["cluster", "id"])
    new = parted.select("id", F.concat_ws("/", F.col("cluster").cast("string"), F.col("part").cast("string")).alias("cluster"))
    dropped = members.join(named, "cluster", "left_semi").join(splits, ["cluster", "id"], "left_anti").select("cluster", "id")
    return same.unionByName(new), dropped


def taxonomy(placements: DataFrame, items: DataFrame, order: Sequence[str]) -> DataFrame:
    """(id, section): the first placement wins, unplaced items go to "other"."""
    first = placements.groupBy("id").agg(F.min_by("section", F.struct(*order, "section")).alias("section"))
    return items.select("id").join(first, "id", "left").withColumn("section", F.coalesce("section", F.lit("other")))


def effective_links(links: DataFrame) -> DataFrame:
    """Links that survived review, with the reviewed relation where there is one."""
    return links.filter("review IS NULL OR review <> 'reject'").select("src", "dst", F.coalesce("review_rel", "rel").alias("rel"))


def evidence_records(clauses: DataFrame, links: DataFrame, twins: DataFrame, size: int = 1000) -> DataFrame:
    """(clause, rel, part, targets): targets by relation in bounded parts, beside twin counts and flags."""
    from corpusloom.functions.scale import collect_chunked

    parts = collect_chunked(links.select("src", "rel", "dst"), ["src", "rel"], ["dst"], {"targets": F.col("dst")}, size)
    out = clauses.join(twins, "clause", "left").fillna(0, ["n_twins"])
    return out.join(parts.withColumnRenamed("src", "clause"), "clause", "left")


def in_strength(edges: DataFrame, w: Column | None = None) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") if w is None else w).alias("strength"))
