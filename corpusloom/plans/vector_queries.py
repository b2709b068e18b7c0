"""Vector operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import clusters, vectors as v
from corpusloom.plans import tables as tb
from corpusloom.plans.registry import query

VEC = tb.VEC
DOT = "round(list_dot_product(x.vec, y.vec), 6)"
UV = f"{VEC}, uv AS (SELECT id, label, list_transform(vec, lambda z: z / CASE WHEN sqrt(list_dot_product(vec, vec)) = 0 THEN 1 ELSE sqrt(list_dot_product(vec, vec)) END) AS vec FROM vecs)"


def knn_sql(k, floor):
    return f"""{UV}, sims AS MATERIALIZED (SELECT x.id, y.id AS other, {DOT} AS score FROM uv x JOIN uv y ON x.id <> y.id), knn AS (SELECT id, other, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM sims WHERE score >= {floor}) WHERE rank <= {k})"""


KNN = knn_sql(20, 0.2)
KNN40 = knn_sql(40, -1)


def unit(spark, sf):
    return tb.vectors(spark, sf).withColumn("vec", v.normalise("vec"))


def knn(spark, sf, k=20, floor=0.2):
    return v.knn(unit(spark, sf), k, floor)


@query("v01_normalise", f"WITH {UV} SELECT id, round(list_sum(vec), 6) AS total, round(vec[1], 6) AS first FROM uv")
def v01(spark, sf):
    return unit(spark, sf).select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col("vec")[0], 6).alias("first"))


QUANT = f"{UV}, qs AS (SELECT id, list_max(list_transform(vec, lambda z: abs(z))) / 127 AS scale, vec FROM uv), qt AS (SELECT id, scale, vec, list_transform(vec, lambda z: CAST(floor(z / scale + 0.5) AS INTEGER)) AS q FROM qs)"


@query("v02_quantise", f"WITH {QUANT} SELECT id, round(scale, 9) AS scale, array_to_string(q, ',') AS q, round(list_sum(list_transform(q, lambda z: z * scale)), 6) AS back FROM qt")
def v02(spark, sf):
    d = unit(spark, sf).withColumn("s", v.quantise("vec"))
    return d.select("id", F.round("s.scale", 9).alias("scale"), F.array_join(F.transform("s.q", lambda x: x.cast("string")), ",").alias("q"), F.round(F.aggregate(v.dequantise("s"), F.lit(0.0), lambda s, x: s + x), 6).alias("back"))


@query("v03_knn", f"WITH {KNN} SELECT id, other, score, rank FROM knn")
def v03(spark, sf):
    return knn(spark, sf)


@query("v03_knn_cells", f"WITH {knn_sql(10, -1)} SELECT id, other, score, rank FROM knn")
def v03b(spark, sf):
    """The same result through cells, bounds and blocks, as a large table takes it."""
    return v.knn(unit(spark, sf), 10, block=128, pivots=12)


@query("v04_reverse", f"WITH {KNN} SELECT other AS id, id AS other, score FROM knn WHERE rank <= 8")
def v04(spark, sf):
    return v.reverse_neighbours(knn(spark, sf), 8)


@query("v05_mutual", f"WITH {KNN} SELECT x.id AS a, x.other AS b, x.score FROM knn x JOIN knn y ON x.id = y.other AND x.other = y.id AND x.id < x.other")
def v05(spark, sf):
    return v.mutual_pairs(knn(spark, sf))


def queries_table(spark, sf, n=20):
    """The first vector of every label is a query."""
    u = unit(spark, sf)
    return u.groupBy("label").agg(F.min_by("vec", "id").alias("vec")).select(F.col("label").alias("qid"), "vec")


QV = "qv AS (SELECT label AS qid, arg_min(vec, id) AS vec FROM uv GROUP BY label)"
HITS = f"{UV}, {QV}, hits AS MATERIALIZED (SELECT qid, y.id, y.label, {DOT} AS score FROM qv x JOIN uv y ON true)"


@query("v06_query_top", f"WITH {HITS} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits) WHERE rank <= 15")
def v06(spark, sf):
    return v.query_top(queries_table(spark, sf), unit(spark, sf), 15).select("qid", "id", "score", "rank")


@query("v07_query_top_one_source", f"WITH {HITS} SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hits WHERE label = 3) WHERE rank <= 8")
def v07(spark, sf):
    return v.query_top(queries_table(spark, sf), unit(spark, sf).filter("label = 3"), 8).select("qid", "id", "score")


@query(
    "v08_multi_source_top",
    f"WITH {HITS}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS r FROM hits) WHERE r <= 3) SELECT qid, id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label, id) AS k FROM p) WHERE k <= 12",
)
def v08(spark, sf):
    return v.multi_source_top(queries_table(spark, sf), unit(spark, sf), "label", 10, 12).select("qid", "id", "label", "score")


def cent_sql(src, by):
    return f"(SELECT {by}, list_transform(s, lambda z: z / sqrt(list_dot_product(s, s))) AS cen, n FROM (SELECT {by}, list(sx ORDER BY d) AS s, max(n) AS n FROM (SELECT {by}, d, sum(x) AS sx, count(*) AS n FROM (SELECT {by}, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM {src}) GROUP BY ALL) GROUP BY {by}))"


@query("v09_proximity", f"WITH {UV}, sd AS (SELECT 0 AS g, vec FROM uv WHERE label = 2), c AS {cent_sql('sd', 'g')} SELECT id, round(list_dot_product(vec, cen), 6) AS prox FROM uv, c")
def v09(spark, sf):
    u = unit(spark, sf)
    return v.proximity(u, u.filter("label = 2")).select("id", "prox")


@query("v10_generality", f"WITH {UV} SELECT x.id, round(avg(list_dot_product(x.vec, y.vec)), 6) AS generality FROM uv x JOIN uv y ON x.id <> y.id GROUP BY x.id")
def v10(spark, sf):
    return v.generality(unit(spark, sf)).select("id", F.round("generality", 6).alias("generality"))


PLACE = "pl AS (SELECT id, label AS grp, id AS pos FROM uv)"
BACK = "bk AS (SELECT id, avg(score) FILTER (rank BETWEEN 21 AND 35) AS back, avg(score) FILTER (rank <= 20) AS density FROM knn GROUP BY id)"
SURP = f"""{KNN40}, {PLACE}, {BACK}, un AS (SELECT least(id, other) AS a, greatest(id, other) AS b, max(score) AS cos FROM knn GROUP BY 1,2),
 sp AS MATERIALIZED (SELECT a, b, cos, round(cos - (x.back + y.back) / 2, 8) AS s FROM un JOIN bk x ON x.id = a JOIN bk y ON y.id = b JOIN pl p ON p.id = a JOIN pl q ON q.id = b WHERE cos < 0.95 AND NOT (p.grp = q.grp AND abs(p.pos - q.pos) <= 2) AND round(cos - (x.back + y.back) / 2, 8) > 0),
 md AS (SELECT s AS m FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM sp) WHERE i = n // 2), su AS (SELECT a, b, cos, s, s / (s + m) AS f FROM sp, md)"""


def place(u):
    return u.select("id", F.col("label").alias("grp"), F.col("id").alias("pos"))


def surprise(spark, sf):
    u = unit(spark, sf)
    table = v.cut_lineage(v.knn(u, 40))
    back = v.background(table)
    return u, table, back, v.surprise_pairs(table, back, place(u))


@query("v11_surprise", f"WITH {SURP} SELECT a, b, cos, s, round(f, 6) AS f FROM su")
def v11(spark, sf):
    return surprise(spark, sf)[3].select("a", "b", "cos", "s", F.round("f", 6).alias("f"))


@query("v12_similar_pairs", f"WITH {UV} SELECT x.id AS a, y.id AS b, {DOT} AS score FROM uv x JOIN uv y ON x.id < y.id WHERE x.label < 6 AND y.label < 6 AND {DOT} >= 0.3")
def v12(spark, sf):
    return v.similar_pairs(unit(spark, sf).filter("label < 6"), 0.3, block=100)


@query("v13_spherical_kmeans")
def v13(spark, sf):
    return clusters.spherical_kmeans(unit(spark, sf).select("id", "vec"), 10)[0].select("id", "cluster")


@query("v13_farthest_point_seeds")
def v13b(spark, sf):
    return clusters.farthest_points(unit(spark, sf).select("id", "vec"), 0, 8)


@query("v14_two_level")
def v14(spark, sf):
    return clusters.two_level(unit(spark, sf).select("id", "vec"), 12, 4)


@query("v15_sense_split")
def v15(spark, sf):
    return clusters.sense_split(unit(spark, sf).select(F.col("label").alias("item"), "id", "vec")).select("item", "n", "n_a", "n_b", "score")


SUMM = f"{UV}, ce AS {cent_sql('uv', 'label')}, sm AS (SELECT u.label AS cluster, id, round(list_dot_product(vec, cen), 6) AS sim FROM uv u JOIN ce ON ce.label = u.label)"


@query("v16_cluster_summary", f"WITH {SUMM} SELECT cluster, arg_min(id, {{'s': -sim, 'i': id}}) AS rep, round(avg(sim), 3) AS cohesion, count(*) AS size, arg_min(id, {{'s': -(id % 13), 'i': id}}) AS mother FROM sm GROUP BY cluster")
def v16(spark, sf):
    u = unit(spark, sf).withColumnRenamed("label", "cluster")
    deg = u.select("id", (F.col("id") % 13).alias("degree"))
    return v.cluster_summary(u, v.centroids(u, ["cluster"]), deg)


@query("v17_cluster_cleanup")
def v17(spark, sf):
    u = unit(spark, sf).select("id", "vec", F.when(F.col("id") % 50 == 0, F.col("id") + 100).otherwise(F.col("label")).alias("cluster"))
    return clusters.clean_up(u, 5, 0.98)


@query("v18_disjoint_fields")
def v18(spark, sf):
    t = v.knn(unit(spark, sf), 12, 0.3)
    freq = unit(spark, sf).select("id", (F.col("id") * 7919 % 1000).alias("freq"))
    return clusters.disjoint_fields(t, freq, 0.35)


@query("v19_top_neighbour_quantiles", f"WITH {knn_sql(12, 0.3)}, t AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM knn WHERE rank = 1) SELECT p, score AS value FROM t, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS p) WHERE i = floor(p * (n - 1))")
def v19(spark, sf):
    from corpusloom.operators.stats import index_quantiles

    t = v.knn(unit(spark, sf), 12, 0.3).filter("rank = 1")
    return index_quantiles(t, "score", [0.1, 0.5, 0.9])


@query(
    "v20_quantisation_check",
    f"""WITH {QUANT}, dv AS (SELECT id, list_transform(q, lambda z: z * scale) AS vec FROM qt), q AS (SELECT label AS qid, arg_min(vec, id) AS vec FROM uv GROUP BY label),
 e AS (SELECT qid, y.id, row_number() OVER (PARTITION BY qid ORDER BY {DOT} DESC, y.id) AS r FROM q x JOIN uv y ON true), a AS (SELECT qid, y.id, row_number() OVER (PARTITION BY qid ORDER BY {DOT} DESC, y.id) AS r FROM q x JOIN dv y ON true)
 SELECT e.qid, bool_or(e.r = 1 AND a.r = 1) AS same_top, count(*) AS overlap FROM e JOIN a ON a.qid = e.qid AND a.id = e.id WHERE e.r <= 10 AND a.r <= 10 GROUP BY 1""",
)
def v20(spark, sf):
    u = unit(spark, sf)
    back = u.withColumn("s", v.quantise("vec")).select("id", v.dequantise("s").alias("vec"))
    q = queries_table(spark, sf)
    a = v.query_top(q, u, 10).select("qid", "id", F.col("rank").alias("r1"))
    b = v.query_top(q, back, 10).select("qid", "id", F.col("rank").alias("r2"))
    return a.join(b, ["qid", "id"]).groupBy("qid").agg(F.bool_or((F.col("r1") == 1) & (F.col("r2") == 1)).alias("same_top"), F.count(F.lit(1)).alias("overlap"))


TOP30 = "t30 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM hits) WHERE r <= 30)"


@query(
    "v21_relevance_gate",
    f"""WITH {HITS}, {TOP30}, g AS (SELECT *, score >= round(max(score) OVER (PARTITION BY qid) - 0.15, 6) AND score >= 0.5 AS ok FROM t30), c AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY qid) AS n FROM g),
 f AS (SELECT qid, id, score, round(score + 0.1 * (id % 10) / 10.0, 6) AS final FROM c WHERE CASE WHEN n >= 5 THEN ok ELSE r <= 6 END) SELECT qid, id, score, final FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, id) AS k FROM f) WHERE k <= 8""",
)
def v21(spark, sf):
    hits = v.query_top(queries_table(spark, sf), unit(spark, sf), 30)
    prior = unit(spark, sf).select("id", ((F.col("id") % 10) / 10.0).alias("prior"))
    return v.relevance_gate(hits, prior, 8)


@query(
    "v22_hybrid_thread",
    f"""WITH {HITS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM hits) WHERE r <= 60), s AS (SELECT qid, id, min(o) AS o FROM (SELECT qid, id, 0 AS o FROM hits WHERE id % 60 = qid UNION ALL SELECT qid, id, 1 FROM hits WHERE id % 75 = qid) GROUP BY 1,2),
 f AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM t WHERE (qid, id) NOT IN (SELECT (qid, id) FROM s)), w AS (SELECT *, round(score - lead(score) OVER (PARTITION BY qid ORDER BY r), 6) AS d FROM f WHERE r <= 24),
 c AS (SELECT qid, coalesce(arg_min(r, {{'d': -d, 'r': r}}) FILTER (d > 0), max(r)) AS cut FROM w GROUP BY 1), tp AS (SELECT qid, max(score) AS top FROM t GROUP BY 1)
 SELECT qid, id, CASE o WHEN 0 THEN 'lex' ELSE 'key' END AS src FROM s UNION ALL SELECT w.qid, id, 'sem' FROM w JOIN c ON c.qid = w.qid JOIN tp ON tp.qid = w.qid WHERE r <= least(cut, 16) AND score >= round(top - 0.10, 6)""",
)
def v22(spark, sf):
    u = unit(spark, sf).select("id")
    q = unit(spark, sf).select(F.col("label").alias("qid")).distinct()
    lex = u.withColumn("qid", F.col("id") % 60).join(q, "qid", "left_semi")
    key = u.withColumn("qid", F.col("id") % 75).join(q, "qid", "left_semi")
    return v.hybrid_thread(lex, key, v.query_top(queries_table(spark, sf), unit(spark, sf), 60))


@query("v23_nearest_centroid", f"WITH {UV}, ce AS {cent_sql('uv', 'label')}, s AS (SELECT id, ce.label AS cluster, round(list_dot_product(vec, cen), 6) AS sim FROM uv JOIN ce ON true) SELECT id, CASE WHEN sim >= 0.55 THEN cluster END AS cluster, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cluster) AS r FROM s) WHERE r = 1")
def v23(spark, sf):
    u = unit(spark, sf).withColumnRenamed("label", "cluster")
    return v.nearest_centroid(u, v.centroids(u, ["cluster"]), 0.55)


def incident(pairs_df):
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    return pairs_df.select(F.explode(ends).alias("x"), F.col("f").alias("w")).select("x.*", "w")


def corpus_mean(u):
    return v.generality(u).agg(F.avg("generality")).first()[0]


@query("v24_diversity_sum")
def v24(spark, sf):
    u, table, back, s = surprise(spark, sf)
    return v.diversity_sum(incident(s), u, back, corpus_mean(u)).select("node", F.round("ds", 6).alias("ds"))


@query("v25_suppress_near_duplicates")
def v25(spark, sf):
    u = unit(spark, sf)
    t = v.knn(u, 20, 0.2)
    items = t.select(F.col("id").alias("hub"), F.col("other").alias("id"), F.col("score").alias("w"))
    return v.suppress_near_duplicates(items, u, 0.6, 10)
