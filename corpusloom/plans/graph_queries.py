"""Graph operators on neighbour graphs of the vectors and on the basket tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.scale import cut_lineage
from corpusloom.operators import graph as g
from corpusloom.operators import pairs
from corpusloom.operators import vectors as v
from corpusloom.plans import tables as tb
from corpusloom.plans import vector_queries as vq
from corpusloom.plans.registry import query

K6 = vq.knn_sql(6, -1)
GEN = "gen AS (SELECT x.id, round(avg(list_dot_product(x.vec, y.vec)), 9) AS g FROM uv x JOIN uv y ON x.id <> y.id GROUP BY x.id)"
UND = "und AS (SELECT least(id, other) AS a, greatest(id, other) AS b, max(score) AS w FROM knn GROUP BY 1,2)"
DIR = f"{K6}, {GEN}, {UND}, dir AS (SELECT CASE WHEN x.g >= y.g THEN b ELSE a END AS src, CASE WHEN x.g >= y.g THEN a ELSE b END AS dst, w FROM und JOIN gen x ON x.id = a JOIN gen y ON y.id = b)"
REL = "['explains','limits','repeats']"
LINKS = f"{K6}, links AS (SELECT id AS src, other AS dst, score AS w, {REL}[CAST((id + other) % 3 AS INTEGER) + 1] AS rel, CASE WHEN id * other % 7 = 0 THEN 'reject' WHEN id * other % 7 = 1 THEN 'keep' END AS review, CASE WHEN id * other % 11 = 0 THEN 'repeats' END AS review_rel FROM knn)"


def unit(spark, sf):
    return vq.unit(spark, sf)


def knn(spark, sf, k=6):
    return cut_lineage(v.knn(unit(spark, sf), k))


def und(spark, sf, table=None):
    table = knn(spark, sf) if table is None else table
    return g.undirected(table.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("score").alias("w")))


def directed(spark, sf, table=None):
    return cut_lineage(g.orient(und(spark, sf, table), v.generality(unit(spark, sf))))


def links(spark, sf):
    rel = F.element_at(F.array(F.lit("explains"), F.lit("limits"), F.lit("repeats")), ((F.col("id") + F.col("other")) % 3 + 1).cast("int"))
    p = F.col("id") * F.col("other")
    return knn(spark, sf).select(
        F.col("id").alias("src"), F.col("other").alias("dst"), F.col("score").alias("w"), rel.alias("rel"),
        F.when(p % 7 == 0, "reject").when(p % 7 == 1, "keep").alias("review"), F.when(p % 11 == 0, "repeats").alias("review_rel"),
    )


def nodes(spark, sf):
    return unit(spark, sf).select(F.col("id").alias("node"))


@query("g01_orient", f"WITH {DIR} SELECT src, dst, w FROM dir")
def g01(spark, sf):
    return directed(spark, sf)


def rounds_sql(body: str, start: str, rounds: int, final: str) -> str:
    """Chain of materialised rounds of a fixed iteration."""
    ctes = [f"s0 AS MATERIALIZED ({start})"]
    for i in range(rounds):
        ctes.append(f"s{i + 1} AS MATERIALIZED ({body.replace('@', f's{i}')})")
    return ", ".join(ctes) + " " + final.replace("@", f"s{rounds}")


SHARE = "sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM dir), nn AS (SELECT count(*) AS n FROM uv)"
PR = rounds_sql(
    "SELECT x.id AS node, 0.15 / n + 0.85 * coalesce(f, 0) + 0.85 * (1 - tot) / n AS rank FROM uv x LEFT JOIN (SELECT dst, sum(rank * p) AS f FROM sh JOIN @ ON @.node = src GROUP BY dst) q ON q.dst = x.id, nn, (SELECT sum(rank * p) AS tot FROM sh JOIN @ ON @.node = src)",
    "SELECT id AS node, 1.0 / n AS rank FROM uv, nn", 40, "SELECT node, round(rank, 7) AS rank FROM @",
)


@query("g02_pagerank", f"WITH {DIR}, {SHARE}, {PR}")
def g02(spark, sf):
    return g.pagerank(nodes(spark, sf), directed(spark, sf)).select("node", F.round("rank", 7).alias("rank"))


HI = rounds_sql(
    "SELECT x.id AS node, coalesce(a, 0) / (SELECT sqrt(sum(a * a)) FROM (SELECT sum(hub * w) AS a FROM dir JOIN @ ON @.node = src GROUP BY dst)) AS authority, coalesce(h, 0) / (SELECT sqrt(sum(h * h)) FROM (SELECT sum(a * w) AS h FROM dir JOIN (SELECT dst AS d2, sum(hub * w) AS a FROM dir JOIN @ ON @.node = src GROUP BY dst) ON d2 = dst GROUP BY src)) AS hub"
    " FROM uv x LEFT JOIN (SELECT dst, sum(hub * w) AS a FROM dir JOIN @ ON @.node = src GROUP BY dst) q ON q.dst = x.id LEFT JOIN (SELECT src, sum(a * w) AS h FROM dir JOIN (SELECT dst AS d2, sum(hub * w) AS a FROM dir JOIN @ ON @.node = src GROUP BY dst) ON d2 = dst GROUP BY src) r ON r.src = x.id",
    "SELECT id AS node, 1.0::DOUBLE AS authority, 1.0::DOUBLE AS hub FROM uv", 30, "SELECT node, round(authority, 6) AS authority, round(hub, 6) AS hub FROM @",
)


@query("g03_hits", f"WITH {DIR}, {HI}")
def g03(spark, sf):
    return g.hits(nodes(spark, sf), directed(spark, sf)).select("node", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


@query("g04_rank_fusion", f"WITH {DIR}, s AS (SELECT id AS node, round(coalesce(sum(w), 0), 6) AS strength, count(w) AS deg FROM uv LEFT JOIN dir ON dst = id GROUP BY 1), r AS (SELECT node, row_number() OVER (ORDER BY strength DESC, node) AS r_strength, row_number() OVER (ORDER BY deg DESC, node) AS r_deg FROM s) SELECT node, r_strength, r_deg, r_strength + r_deg AS fused FROM r")
def g04(spark, sf):
    n = nodes(spark, sf)
    d = directed(spark, sf)
    s = d.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("deg"))
    scores = n.join(s, "node", "left").select("node", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("strength"), F.coalesce("deg", F.lit(0)).alias("deg"))
    return g.rank_fusion(scores, ["strength", "deg"])


@query(
    "g05_central_nodes",
    f"""WITH {DIR}, p AS (SELECT dst AS node, y.label AS grp, w AS s FROM dir JOIN uv x ON x.id = src JOIN uv y ON y.id = dst WHERE x.label = y.label UNION ALL SELECT knn.id, y.label, score * 0.5 FROM knn JOIN uv x ON x.id = other JOIN uv y ON y.id = knn.id WHERE x.label = y.label UNION ALL SELECT id, label, 0 FROM uv),
 t AS (SELECT grp, node, round(sum(s), 8) AS score FROM p GROUP BY 1,2) SELECT grp, node, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, node) AS r FROM t) WHERE r = 1""",
)
def g05(spark, sf):
    t = knn(spark, sf)
    return g.central_nodes(directed(spark, sf, t), t, vq.place(unit(spark, sf)))


def key_sets(spark, sf):
    """Rare-key sets of the vector items: parts of the orders with the item's number."""
    u = unit(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    li = tb.load(spark, sf, "lineitem").withColumn("n", u.scalar())
    return pairs.rare_key_sets(li.select((F.col("l_orderkey") % F.col("n")).alias("unit_id"), (F.col("l_partkey") % 400).alias("key")), 150)


def hybrid_edges(spark, sf):
    u, table, back, s = vq.surprise(spark, sf)
    s = cut_lineage(pairs.containment(s, key_sets(spark, sf)))
    mean = vq.corpus_mean(u)
    ds = cut_lineage(v.diversity_sum(vq.incident(s), u, back, mean))
    return u, back, mean, s, ds


@query("g06_hybrid_authority")
def g06(spark, sf):
    u, back, mean, s, ds = hybrid_edges(spark, sf)
    e = cut_lineage(g.contained_edges(s, ds, 0.3, 0.1))
    inc = e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "w")
    prior = u.select(F.col("id").alias("node")).join(v.diversity_sum(inc, u, back, mean, 30), "node", "left").select("node", F.coalesce("ds", F.lit(0.0)).alias("prior"))
    return g.damped_flow(prior, e).select("node", F.round("score", 4).alias("score"))


@query(
    "g07_cross_theme",
    f"""WITH {DIR}, e AS (SELECT src, dst, round(w, 9) AS w FROM dir), m AS (SELECT w AS m FROM (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS n FROM e) WHERE i = n // 2),
 s AS (SELECT dst AS node, label, count(*) AS n, sum(w) AS s FROM e JOIN uv ON uv.id = src, m WHERE w >= m GROUP BY 1,2) SELECT node, count(*) FILTER (n >= 2) AS span, round(sum(s) / sum(n), 6) AS mean_w FROM s GROUP BY 1""",
)
def g07(spark, sf):
    th = unit(spark, sf).select("id", F.col("label").alias("theme"))
    return g.cross_theme(directed(spark, sf), th).select("node", "span", F.round("mean_w", 6).alias("mean_w"))


def diversity(spark, sf):
    u = unit(spark, sf)
    rare = key_sets(spark, sf).filter("rare").select(F.col("unit_id").alias("id"), "key")
    return u, cut_lineage(g.diversity_parts(directed(spark, sf), u, vq.place(u), rare))


@query(
    "g08_diversity_parts",
    f"""WITH {DIR}, b AS (SELECT dst AS node, sum(w) AS strength, count(*) AS n FROM dir GROUP BY 1 HAVING count(*) >= 3), mp AS (SELECT x.dst AS node, sum(list_dot_product(p.vec, q.vec)) AS s FROM dir x JOIN dir y ON y.dst = x.dst AND x.src <> y.src JOIN uv p ON p.id = x.src JOIN uv q ON q.id = y.src GROUP BY 1),
 gc AS (SELECT dst AS node, label, count(*) AS c FROM dir JOIN uv ON uv.id = src GROUP BY 1,2), ge AS (SELECT node, exp(-sum(p * ln(p))) AS e FROM (SELECT node, c / sum(c) OVER (PARTITION BY node) AS p FROM gc) GROUP BY 1)
 SELECT b.node, b.n, round(strength, 6) AS strength, round(greatest(0, 1 - s / (b.n * (b.n - 1))), 6) AS dispersion, round(e / b.n, 6) AS group_ratio FROM b JOIN mp ON mp.node = b.node JOIN ge ON ge.node = b.node""",
)
def g08(spark, sf):
    p = diversity(spark, sf)[1]
    return p.select("node", "n", *[F.round(c, 6).alias(c) for c in ("strength", "dispersion", "group_ratio")])


@query("g08_diversity_authority")
def g08b(spark, sf):
    u, p = diversity(spark, sf)
    t = g.diversity_authority(p, u)[1]
    return t.select("combo", F.round("mean_cos", 6).alias("mean_cos"), "median_degree", "redundancy", "chosen")


@query("g09_length_directed")
def g09(spark, sf):
    e = cut_lineage(und(spark, sf))
    ratio = pairs.containment(e.select("a", "b"), key_sets(spark, sf))
    lens = unit(spark, sf).select("id", (F.col("id") * 31 % 17).alias("len"))
    return g.length_directed(e, lens, ratio, 0.2).select("src", "dst", F.round("c", 6).alias("c"), F.round("w", 6).alias("w"))


@query("g10_surprise_authority")
def g10(spark, sf):
    u, back, mean, s, ds = hybrid_edges(spark, sf)
    e = cut_lineage(g.soft_edges(s.drop("c_ab", "c_ba"), ds))
    inc = e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "w")
    prior = u.select(F.col("id").alias("node")).join(v.diversity_sum(inc, u, back, mean, 30), "node", "left").select("node", F.coalesce("ds", F.lit(0.0)).alias("prior"))
    return g.damped_flow(prior, e).select("node", F.round("score", 4).alias("score"))


TREE_E = "te AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey % 16 <> 0)"


def tree_edges(spark, sf):
    return tb.load(spark, sf, "part").filter("p_partkey % 16 <> 0").selectExpr("p_partkey src", "p_partkey div 2 dst")


@query("g11_components", f"WITH RECURSIVE {TREE_E}, b AS (SELECT src AS n, dst AS o FROM te UNION SELECT dst, src FROM te), r AS (SELECT DISTINCT n AS node, n AS root FROM b UNION SELECT b.o, r.root FROM r JOIN b ON b.n = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def g11(spark, sf):
    return g.components(tree_edges(spark, sf))


@query("g11_giant_share", f"WITH RECURSIVE {TREE_E}, b AS (SELECT src AS n, dst AS o FROM te UNION SELECT dst, src FROM te), r AS (SELECT DISTINCT n AS node, n AS root FROM b UNION SELECT b.o, r.root FROM r JOIN b ON b.n = r.node), c AS (SELECT component, count(*) AS n FROM (SELECT node, min(root) AS component FROM r GROUP BY node) GROUP BY 1) SELECT count(*) AS components, max(n) AS giant, round(max(n) / sum(n), 6) AS share FROM c")
def g11b(spark, sf):
    return g.giant_share(g.components(tree_edges(spark, sf)))


@query(
    "g12_hop_distances",
    f"WITH RECURSIVE {K6}, b AS (SELECT id AS n, other AS o FROM knn UNION SELECT other, id FROM knn), s AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, CAST(ceil(count(*) OVER () / 120.0) AS BIGINT) AS st FROM uv) WHERE i % st = 0), r AS (SELECT id AS source, id AS node, 0 AS hops FROM s UNION SELECT source, b.o, hops + 1 FROM r JOIN b ON b.n = r.node WHERE hops < 9) SELECT source, node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1,2",
)
def g12(spark, sf):
    e = knn(spark, sf).select(F.col("id").alias("src"), F.col("other").alias("dst"))
    return g.hop_distances(e, g.systematic_sample(nodes(spark, sf), "node", 120))


@query(
    "g12_hop_statistics",
    f"WITH RECURSIVE {K6}, b AS (SELECT DISTINCT n, o FROM (SELECT id AS n, other AS o FROM knn WHERE score >= 0.3 UNION ALL SELECT other, id FROM knn WHERE score >= 0.3)), c AS (SELECT n AS node, n AS root FROM b UNION SELECT b.o, c.root FROM c JOIN b ON b.n = c.node), m AS (SELECT node, min(root) AS comp FROM c GROUP BY 1), big AS (SELECT comp FROM m GROUP BY 1 ORDER BY count(*) DESC, comp LIMIT 1), gi AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS n FROM m WHERE comp IN (FROM big)), s AS (SELECT node FROM gi WHERE i % CAST(ceil(n / 120.0) AS BIGINT) = 0), r AS (SELECT node AS source, node, 0 AS hops FROM s UNION SELECT source, b.o, hops + 1 FROM r JOIN b ON b.n = r.node WHERE hops < 24), d AS (SELECT source, node, min(hops) AS h FROM r GROUP BY 1, 2) SELECT (SELECT max(n) FROM gi) AS giant, count(DISTINCT source) AS sources, round(avg(h), 6) AS mean, CAST(max(h) AS INTEGER) AS longest FROM d WHERE h > 0",
)
def g12_statistics(spark, sf):
    e = knn(spark, sf).filter("score >= 0.3").select(F.col("id").alias("src"), F.col("other").alias("dst"))
    return g.hop_statistics(e).select("giant", "sources", F.round("mean", 6).alias("mean"), "longest")


@query(
    "g13_upstream_roots",
    f"WITH RECURSIVE {DIR}, rt AS (SELECT DISTINCT src AS node FROM dir WHERE src NOT IN (SELECT dst FROM dir)), r AS (SELECT node, node AS root FROM rt UNION SELECT d.dst, r.root FROM r JOIN dir d ON d.src = r.node), s AS (SELECT node, root, round(list_dot_product(x.vec, y.vec), 3) AS sim FROM r JOIN uv x ON x.id = node JOIN uv y ON y.id = root WHERE node <> root) SELECT node, root, sim FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY sim DESC, root) AS k FROM s) WHERE k <= 3",
)
def g13(spark, sf):
    return g.upstream_roots(directed(spark, sf), unit(spark, sf))


@query("g14_communities")
def g14(spark, sf):
    return g.best_communities(und(spark, sf))


GIVEN = "gv AS (SELECT 0 AS run, id AS node, CAST(label AS BIGINT) AS community FROM uv UNION ALL SELECT 1, id, id % 7 FROM uv UNION ALL SELECT 2, id, label + 10 * (id % 2) FROM uv)"


def given_runs(spark, sf):
    u = unit(spark, sf)
    runs = [F.col("label").cast("long"), F.col("id") % 7, F.col("label") + 10 * (F.col("id") % 2)]
    return u.select("id", F.posexplode(F.array(*[r.cast("long") for r in runs]))).select(F.col("pos").alias("run"), F.col("id").alias("node"), F.col("col").alias("community"))


@query("g14_modularity", f"WITH {K6}, {UND}, {GIVEN}, e AS (SELECT x.run, x.community AS ca, y.community AS cb, w FROM und JOIN gv x ON x.node = a JOIN gv y ON y.node = b AND y.run = x.run), whole AS (SELECT 2 * sum(w) AS m FROM und), dg AS (SELECT run, c, sum(w) AS deg FROM (SELECT run, ca AS c, w FROM e UNION ALL SELECT run, cb, w FROM e) GROUP BY 1, 2), ins AS (SELECT run, ca AS c, 2 * sum(w) AS inw FROM e WHERE ca = cb GROUP BY 1, 2) SELECT CAST(dg.run AS INTEGER) AS run, round(sum(coalesce(inw, 0) / m - (deg / m) * (deg / m)), 6) AS modularity FROM dg LEFT JOIN ins ON ins.run = dg.run AND ins.c = dg.c CROSS JOIN whole GROUP BY 1")
def g14_modularity(spark, sf):
    u, runs = cut_lineage(und(spark, sf)), given_runs(spark, sf)
    each = [g.modularity(u, runs.filter(F.col("run") == r)).select(F.lit(r).alias("run"), F.round("modularity", 6).alias("modularity")) for r in range(3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("g15_stability")
def g15(spark, sf):
    runs = g.communities(und(spark, sf), seeds=range(6))
    return g.partition_agreement(runs).select(F.round("agreement", 4).alias("stability"), F.col("pairs").alias("compared"))


@query("g15_agreement", f"WITH {vq.UV}, {GIVEN}, p AS (SELECT x.run, x.community = y.community AS t, a.community = b.community AS t0 FROM gv x JOIN gv y ON x.run = y.run AND x.node < y.node JOIN gv a ON a.run = 0 AND a.node = x.node JOIN gv b ON b.run = 0 AND b.node = y.node WHERE x.run > 0) SELECT round(avg(CAST(t = t0 AS INTEGER)), 9) AS agreement, count(*) AS pairs FROM p")
def g15_agreement(spark, sf):
    return g.partition_agreement(given_runs(spark, sf)).select(F.round("agreement", 9).alias("agreement"), "pairs")


@query("g15_sampled_agreement", f"WITH {vq.UV}, {GIVEN}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM uv), p AS (SELECT x.id AS a, y.id AS b FROM o x JOIN o y ON x.i % 7 = 0 AND y.i >= x.i + 3 AND (y.i - x.i - 3) % 97 = 0), t AS (SELECT x.run, (x.community = y.community) = (u.community = v.community) AS same FROM p JOIN gv x ON x.node = a AND x.run > 0 JOIN gv y ON y.node = b AND y.run = x.run JOIN gv u ON u.node = a AND u.run = 0 JOIN gv v ON v.node = b AND v.run = 0) SELECT round(avg(CAST(same AS INTEGER)), 9) AS stability, count(*) AS compared FROM t")
def g15_sampled(spark, sf):
    return g.partition_stability(given_runs(spark, sf), nodes(spark, sf)).select(F.round("stability", 9).alias("stability"), "compared")


@query(
    "g16_projection",
    f"""WITH {LINKS}, f AS (SELECT dst FROM links GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40), e AS (SELECT x.src AS a, y.src AS b, count(*) AS w FROM links x JOIN links y ON x.dst = y.dst AND x.src < y.src WHERE x.dst IN (FROM f) GROUP BY 1,2
 UNION ALL SELECT x.src, x.dst, 3 FROM links x JOIN links y ON x.src = y.dst AND x.dst = y.src AND x.src < x.dst UNION ALL SELECT least(src, dst), greatest(src, dst), 2 FROM links) SELECT a, b, CAST(sum(w) AS BIGINT) AS w FROM e GROUP BY 1,2""",
)
def g16(spark, sf):
    l = cut_lineage(links(spark, sf))
    return g.rule_projection(l, g.mutual_links(l))


TIERS = "tr AS (SELECT id, label AS theme, CASE WHEN id % 23 = 0 THEN 0 WHEN id % 5 = 1 THEN 1 ELSE 2 END AS tier, vec FROM uv)"


def tiered(spark, sf):
    return unit(spark, sf).select("id", F.col("label").alias("theme"), F.expr("case when id % 23 = 0 then 0 when id % 5 = 1 then 1 else 2 end").alias("tier"), "vec")


@query(
    "g17_layered_parents",
    f"""WITH {vq.UV}, {TIERS}, c AS (SELECT x.id, y.id AS parent, round(list_dot_product(x.vec, y.vec), 6) AS s, CASE WHEN x.theme = y.theme AND y.tier = x.tier - 1 THEN 0 WHEN x.theme = y.theme THEN 1 WHEN y.tier = 0 THEN 2 END AS k FROM tr x JOIN tr y ON y.tier < x.tier),
 p AS (SELECT id, parent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, s DESC, parent) AS r FROM c WHERE k IS NOT NULL) WHERE r = 1)
 SELECT tr.id, parent, CASE WHEN tier = 1 AND tr.id NOT IN (SELECT parent FROM p) THEN 2 ELSE tier END AS tier FROM tr LEFT JOIN p ON p.id = tr.id""",
)
def g17(spark, sf):
    return g.layered_parents(tiered(spark, sf))


TM = f"{LINKS}, {TIERS}, tm AS (SELECT id, tier, (SELECT count(*) FROM links WHERE src = tr.id) AS m FROM tr), xp AS (SELECT node, parent FROM (SELECT dst AS node, src AS parent, row_number() OVER (PARTITION BY dst ORDER BY tier, m DESC, src) AS r FROM links JOIN tm ON tm.id = src WHERE tier < 2) WHERE r = 1)"


def tiers_m(spark, sf, l):
    m = l.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    return tiered(spark, sf).drop("vec").join(m, "id", "left").fillna(0, ["m"])


@query("g18_examined_parents", f"WITH {TM} SELECT node, parent FROM xp")
def g18(spark, sf):
    l = cut_lineage(links(spark, sf))
    return g.examined_parents(l, tiers_m(spark, sf, l))


@query("g19_climb_to_top", f"WITH RECURSIVE {TM}, w AS (SELECT id, id AS cur, tier, 0 AS st FROM tm UNION ALL SELECT w.id, xp.parent, tm.tier, st + 1 FROM w JOIN xp ON xp.node = w.cur JOIN tm ON tm.id = xp.parent WHERE w.tier <> 0 AND st < 11) SELECT tm.id, (SELECT min(cur) FROM w WHERE w.id = tm.id AND w.tier = 0) AS top FROM tm")
def g19(spark, sf):
    l = cut_lineage(links(spark, sf))
    t = cut_lineage(tiers_m(spark, sf, l))
    return g.climb_to_top(g.examined_parents(l, t), t)


@query("g19_child_counts", f"WITH {TM} SELECT parent AS id, count(*) FILTER (tier = 1) AS inner, count(*) FILTER (tier = 2) AS leaves FROM xp JOIN tm ON tm.id = node GROUP BY 1".replace("AS inner", 'AS "inner"'))
def g19b(spark, sf):
    l = cut_lineage(links(spark, sf))
    t = cut_lineage(tiers_m(spark, sf, l))
    return g.child_counts(g.examined_parents(l, t), t)


LAYERS = "ly AS (SELECT src, dst, rel, 'near' AS layer, 0 AS o FROM links WHERE src % 3 = 0 UNION ALL SELECT src, dst, coalesce(review_rel, rel), 'wide', 1 FROM links)"


@query("g20_union_layers", f"WITH {LINKS}, {LAYERS} SELECT src, dst, rel, layer FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY o, rel) AS r FROM ly) WHERE r = 1")
def g20(spark, sf):
    l = links(spark, sf)
    return g.union_layers([("near", l.filter("src % 3 = 0")), ("wide", l.withColumn("rel", F.coalesce("review_rel", "rel")))])


@query("g21_mutual_totals", f"WITH {LINKS}, m AS (SELECT count(*) AS m FROM links x JOIN links y ON x.src = y.dst AND x.dst = y.src AND x.src < x.dst) SELECT (SELECT count(*) FROM links) AS directed, m AS mutual, (SELECT count(*) FROM links) - m AS once FROM m")
def g21(spark, sf):
    return g.link_totals(links(spark, sf))


@query("g22_convergence", f"WITH {LINKS} SELECT dst AS node, count(DISTINCT src) AS sources FROM links GROUP BY 1 HAVING count(DISTINCT src) >= 2")
def g22(spark, sf):
    return g.convergence(links(spark, sf))


@query("g22_hubs_by_relation", f"WITH {LINKS}, n AS (SELECT rel, src AS node, count(*) AS n FROM links GROUP BY 1,2) SELECT rel, node, n FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY n DESC, node) AS r FROM n) WHERE r <= 10")
def g22b(spark, sf):
    return g.hubs_by_relation(links(spark, sf), 10)


@query(
    "g23_grades",
    f"WITH {LINKS}, l AS (SELECT * FROM links WHERE review IS NULL OR review <> 'reject'), d AS (SELECT id AS node, (SELECT count(*) FROM l WHERE src = id) AS n_out, (SELECT count(*) FROM l WHERE dst = id) AS n_in FROM uv) SELECT node, n_out, n_in, CASE WHEN n_out >= 5 AND n_in = 0 THEN 'root' WHEN n_out >= 1 AND n_in >= 1 THEN 'branching' WHEN n_out >= 1 THEN 'brief' ELSE 'bare' END AS grade FROM d",
)
def g23(spark, sf):
    return g.grades(nodes(spark, sf), links(spark, sf), 5)


@query("g24_display_graph", f"WITH {K6} SELECT least(knn.id, other) AS a, greatest(knn.id, other) AS b, max(score) AS w, any_value(p.label) AS a_grp, any_value(q.label) AS b_grp FROM knn JOIN uv p ON p.id = least(knn.id, other) JOIN uv q ON q.id = greatest(knn.id, other) WHERE rank <= 5 GROUP BY 1,2")
def g24(spark, sf):
    return g.display_graph(knn(spark, sf), unit(spark, sf).select("id", F.col("label").alias("grp")))


@query(
    "g25_one_record",
    "SELECT d.doc_id AS id, lang, coalesce(CAST(quality AS BIGINT), -1) AS quality, e.label, coalesce(p.n, 0) AS copies FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings) e ON vec_id = d.doc_id LEFT JOIN (SELECT doc_id AS i, count(*) OVER (PARTITION BY text) AS n FROM documents) p ON i = d.doc_id",
)
def g25(spark, sf):
    d = tb.load(spark, sf, "documents")
    n = d.groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    copies = d.select(F.col("doc_id").alias("id"), F.md5("text").alias("h")).join(n, "h")
    lab = tb.load(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("quality"))
    return g.one_record(d.select(F.col("doc_id").alias("id"), "lang"), [(lab, {"quality": -1}), (unit(spark, sf), {"label": None}), (copies, {"copies": 0})])


@query("g26_null_model")
def g26(spark, sf):
    th = unit(spark, sf).select("id", F.col("label").alias("theme"))
    return g.null_model(links(spark, sf), th, 5)


@query("g27_strict_roots", f"WITH {DIR} SELECT DISTINCT src AS node FROM dir WHERE src NOT IN (SELECT dst FROM dir)")
def g27(spark, sf):
    return g.strict_roots(directed(spark, sf))


@query("g28_apply_splits", f"WITH {vq.UV} SELECT id, CASE WHEN label NOT IN (2, 5) THEN CAST(label AS VARCHAR) ELSE label || '/' || id % 2 END AS cluster FROM uv WHERE label NOT IN (2, 5) OR id % 11 <> 0")
def g28(spark, sf):
    m = unit(spark, sf).select("id", F.col("label").alias("cluster"))
    return g.apply_splits(m, m.filter("cluster IN (2, 5) AND id % 11 <> 0").select("cluster", "id", (F.col("id") % 2).alias("part")))[0]


@query("g28_dropped_members", f"WITH {vq.UV} SELECT label AS cluster, id FROM uv WHERE label IN (2, 5) AND id % 11 = 0")
def g28b(spark, sf):
    m = unit(spark, sf).select("id", F.col("label").alias("cluster"))
    return g.apply_splits(m, m.filter("cluster IN (2, 5) AND id % 11 <> 0").select("cluster", "id", (F.col("id") % 2).alias("part")))[1]


@query("g29_taxonomy", "WITH p AS (SELECT l_partkey AS id, 'S' || l_suppkey % 7 AS section, l_orderkey AS o FROM lineitem) SELECT p_partkey AS id, coalesce((SELECT arg_min(section, {'o': o, 's': section}) FROM p WHERE p.id = p_partkey), 'other') AS section FROM part")
def g29(spark, sf):
    li = tb.load(spark, sf, "lineitem")
    pl = li.selectExpr("l_partkey id", "concat('S', l_suppkey % 7) section", "l_orderkey o")
    return g.taxonomy(pl, tb.load(spark, sf, "part").select(F.col("p_partkey").alias("id")), ["o"])


@query("g30_effective_links", f"WITH {LINKS} SELECT src, dst, coalesce(review_rel, rel) AS rel FROM links WHERE review IS NULL OR review <> 'reject'")
def g30(spark, sf):
    return g.effective_links(links(spark, sf))


@query(
    "g31_evidence_records",
    f"WITH {LINKS}, n AS (SELECT src, rel, dst, row_number() OVER (PARTITION BY src, rel ORDER BY dst) AS r FROM links), p AS (SELECT src, rel, (r-1)//1000 AS part, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS targets FROM n GROUP BY 1,2,3) SELECT id AS clause, label, id % 4 * CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS n_twins, rel, part, targets FROM uv LEFT JOIN p ON src = id",
)
def g31(spark, sf):
    c = unit(spark, sf).select(F.col("id").alias("clause"), "label")
    tw = c.filter("clause % 3 = 0").select("clause", (F.col("clause") % 4).alias("n_twins"))
    r = g.evidence_records(c, links(spark, sf), tw)
    return r.withColumn("targets", F.array_join(F.transform("targets", lambda x: x.cast("string")), ","))
