"""Segmentation, rules, tiers, evaluation on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.scale import cut_lineage
from corpusloom.operators import evaluate as ev
from corpusloom.operators import sequence as q
from corpusloom.operators import textops
from corpusloom.plans import graph_queries as gq
from corpusloom.plans import model_queries as mq
from corpusloom.plans import tables as tb
from corpusloom.plans import vector_queries as vq
from corpusloom.plans.registry import query

T, TT = tb.TURNS, tb.TURN_TOK
TV = f"{vq.UV}, tv AS (SELECT conv_id AS grp, turn + 1 AS pos, vec FROM conversations JOIN uv ON uv.id = (conv_id * 8 + turn) % (SELECT count(*) FROM uv))"


def turn_vectors(spark, sf):
    u = vq.unit(spark, sf)
    n = u.agg(F.count(F.lit(1)))
    c = tb.load(spark, sf, "conversations").withColumn("n", n.scalar())
    return c.select(F.col("conv_id").alias("grp"), (F.col("turn") + 1).alias("pos"), ((F.col("conv_id") * 8 + F.col("turn")) % F.col("n")).alias("id")).join(u, "id").select("grp", "pos", "vec")


def add_sql(x, y):
    return f"CASE WHEN {y} IS NULL THEN {x} ELSE list_transform(generate_series(1, 64), lambda i: ({x})[i] + ({y})[i]) END"


SIM = f"""{TV}, nb AS (SELECT grp, pos, vec AS v0, lag(vec) OVER w AS vm, lead(vec) OVER w AS v1, lead(vec, 2) OVER w AS v2 FROM tv WINDOW w AS (PARTITION BY grp ORDER BY pos)),
 lr AS (SELECT grp, pos, {add_sql('v0', 'vm')} AS l, {add_sql('v1', 'v2')} AS r FROM nb WHERE v1 IS NOT NULL),
 sim AS (SELECT grp, pos, round(list_dot_product(l, r) / sqrt(list_dot_product(l, l)) / sqrt(list_dot_product(r, r)), 9) AS sim FROM lr)"""


@query(
    "q01_texttiling_depth",
    f"""WITH RECURSIVE {SIM}, lf AS (SELECT grp, pos, pos AS at, sim AS p FROM sim UNION ALL SELECT l.grp, l.pos, s.pos, s.sim FROM lf l JOIN sim s ON s.grp = l.grp AND s.pos = l.at - 1 AND s.sim >= l.p),
 rf AS (SELECT grp, pos, pos AS at, sim AS p FROM sim UNION ALL SELECT l.grp, l.pos, s.pos, s.sim FROM rf l JOIN sim s ON s.grp = l.grp AND s.pos = l.at + 1 AND s.sim >= l.p)
 SELECT s.grp, s.pos, round(s.sim, 6) AS sim, round((SELECT max(p) FROM lf WHERE lf.grp = s.grp AND lf.pos = s.pos) + (SELECT max(p) FROM rf WHERE rf.grp = s.grp AND rf.pos = s.pos) - 2 * s.sim, 6) AS depth FROM sim s""",
)
def q01(spark, sf):
    gaps = cut_lineage(q.gap_similarity(turn_vectors(spark, sf), 64))
    return q.texttiling_depth(gaps).select("grp", "pos", F.round("sim", 6).alias("sim"), F.round("depth", 6).alias("depth"))


KEYS = f"{TT}, kdf AS (SELECT key FROM (SELECT DISTINCT grp, pos, key FROM ttok WHERE key IS NOT NULL) GROUP BY key HAVING count(*) <= 0.15 * (SELECT count(*) FROM conversations)), ks AS (SELECT DISTINCT grp, pos, key FROM ttok WHERE key IN (FROM kdf))"


def turn_key_sets(spark, sf):
    t = tb.turn_tokens(spark, sf).dropna(subset=["key"]).select("grp", "pos", "key").distinct()
    total = tb.turns(spark, sf).agg(F.count(F.lit(1)))
    ok = t.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("t", total.scalar()).filter("n <= 0.15 * t")
    sets = t.join(ok, "key", "left_semi").groupBy("grp", "pos").agg(F.collect_set("key").alias("keys"))
    return tb.turns(spark, sf).select("grp", "pos").join(sets, ["grp", "pos"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


@query(
    "q02_vocabulary_break",
    f"""WITH {T}, {KEYS}, gp AS (SELECT grp, pos FROM turns t WHERE EXISTS (FROM turns n WHERE n.grp = t.grp AND n.pos = t.pos + 1)),
 l AS (SELECT DISTINCT g.grp, g.pos, key FROM gp g JOIN ks ON ks.grp = g.grp AND ks.pos IN (g.pos - 1, g.pos)), r AS (SELECT DISTINCT g.grp, g.pos, key FROM gp g JOIN ks ON ks.grp = g.grp AND ks.pos IN (g.pos + 1, g.pos + 2)),
 c AS (SELECT g.grp, g.pos, (SELECT count(*) FROM l WHERE l.grp = g.grp AND l.pos = g.pos) AS nl, (SELECT count(*) FROM r WHERE r.grp = g.grp AND r.pos = g.pos) AS nr, (SELECT count(*) FROM l JOIN r USING (grp, pos, key) WHERE l.grp = g.grp AND l.pos = g.pos) AS i FROM gp g)
 SELECT grp, pos, round(CASE WHEN least(nl, nr) >= 4 THEN 1 - i / least(nl, nr) ELSE 0 END, 6) AS brk FROM c""",
)
def q02(spark, sf):
    return q.vocabulary_break(turn_key_sets(spark, sf)).select("grp", "pos", F.round("brk", 6).alias("brk"))


CATS = f"{TT}, cc AS (SELECT grp, pos, count(*) FILTER (length(surface) = 3) AS c1, count(*) FILTER (length(surface) = 5) AS c2, count(*) FILTER (length(surface) = 7) AS c3 FROM ttok GROUP BY 1,2)"


@query(
    "q03_category_shift",
    f"""WITH {CATS}, n AS (SELECT grp, pos, c1, c2, c3, c1 + c2 + c3 AS t0, coalesce(lag(c1) OVER w, 0) AS m1, coalesce(lag(c2) OVER w, 0) AS m2, coalesce(lag(c3) OVER w, 0) AS m3, lead(c1) OVER w AS a1, lead(c2) OVER w AS a2, lead(c3) OVER w AS a3,
  coalesce(lead(c1, 2) OVER w, 0) AS b1, coalesce(lead(c2, 2) OVER w, 0) AS b2, coalesce(lead(c3, 2) OVER w, 0) AS b3 FROM cc WINDOW w AS (PARTITION BY grp ORDER BY pos)),
 s AS (SELECT grp, pos, CASE WHEN t0 > 0 THEN [c1, c2, c3] ELSE [c1 + m1, c2 + m2, c3 + m3] END AS l, CASE WHEN a1 + a2 + a3 > 0 THEN [a1, a2, a3] ELSE [a1 + b1, a2 + b2, a3 + b3] END AS r FROM n WHERE a1 IS NOT NULL),
 x AS (SELECT *, list_sum(l) AS lt, list_sum(r) AS rt FROM s) SELECT grp, pos, round(CASE WHEN lt >= 3 AND rt >= 3 THEN (abs(l[2] / lt - r[2] / rt) + abs(l[3] / lt - r[3] / rt)) / 2 ELSE 0 END, 6) AS shift FROM x""",
)
def q03(spark, sf):
    ln = F.length("surface")
    c = tb.turn_tokens(spark, sf).groupBy("grp", "pos").agg(*[F.count(F.when(ln == n, 1)).alias(k) for k, n in (("c1", 3), ("c2", 5), ("c3", 7))])
    return q.category_shift(c).select("grp", "pos", F.round("shift", 6).alias("shift"))


EVE = "ev AS (SELECT user_id AS grp, event_id AS pos, event_type AS ending FROM events)"


@query(
    "q04_ending_change",
    f"WITH {EVE}, n AS (SELECT grp, pos, ending AS e0, lag(ending) OVER w AS m, lead(ending) OVER w AS e1, lead(ending, 2) OVER w AS e2 FROM ev WINDOW w AS (PARTITION BY grp ORDER BY pos)) SELECT grp, pos, CAST(e0 <> e1 AND (m IS NULL OR m = e0) AND (e2 IS NULL OR e1 = e2) AS INTEGER) AS ending_shift FROM n WHERE e1 IS NOT NULL",
)
def q04(spark, sf):
    e = tb.load(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("pos"), F.col("event_type").alias("ending"))
    return q.ending_change(e)


OPEN, CLOSE, PATS = ["The ", "And ", "De "], ["the.", "of.", "and."], "^(An|In|Le)[a-z]* "
CUES = f"""cu AS (SELECT grp, pos, CAST({' OR '.join(f"starts_with(nx, '{s}')" for s in OPEN)} AS INTEGER) AS opener, CAST({' OR '.join(f"contains(right(text, 60), '{s}')" for s in CLOSE)} AS INTEGER) AS closer, CAST(regexp_matches(nx, '{PATS}') AS INTEGER) AS verbal
 FROM (SELECT *, lead(text) OVER (PARTITION BY grp ORDER BY pos) AS nx FROM turns) WHERE nx IS NOT NULL)"""


@query("q05_surface_cues", f"WITH {T}, {CUES} SELECT * FROM cu")
def q05(spark, sf):
    return q.surface_cues(tb.turns(spark, sf), {"opener": OPEN}, {"closer": CLOSE}, {"verbal": PATS})


WEIGHTS = {"sim": -1.0, "opener": 0.7, "closer": 0.9, "verbal": -0.4}
CLS = f"""{SIM}, {T}, {CUES}, sc AS (SELECT grp, pos, round(-1.0 * sim + 0.7 * opener + 0.9 * closer - 0.4 * verbal, 6) AS score FROM sim JOIN cu USING (grp, pos)),
 so AS (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS i, count(*) OVER () AS n FROM sc), th AS (SELECT max(CASE WHEN i = CAST(floor(n * 0.09) AS BIGINT) THEN score END) AS hi, max(CASE WHEN i = CAST(floor(n * 0.43) AS BIGINT) THEN score END) AS lo FROM so),
 cl AS (SELECT grp, pos, score, CASE WHEN score >= hi THEN 'boundary' WHEN score >= lo THEN 'gray' ELSE 'continuation' END AS cls FROM sc, th)"""


def classified(spark, sf):
    gaps = q.gap_similarity(turn_vectors(spark, sf), 64).join(q05(spark, sf), ["grp", "pos"])
    return cut_lineage(q.classify_gaps(gaps, WEIGHTS).select("grp", "pos", "score", "cls"))


@query("q06_gap_classes", f"WITH {CLS} SELECT grp, pos, score, cls FROM cl")
def q06(spark, sf):
    return classified(spark, sf)


VERD = "vd AS (SELECT conv_id AS grp, turn + 1 AS pos, CASE (conv_id + turn) % 3 WHEN 0 THEN 'boundary' WHEN 1 THEN 'continuation' ELSE 'unsure' END AS verdict FROM conversations WHERE conv_id % 2 = 0)"


def verdicts(spark, sf):
    c = tb.load(spark, sf, "conversations").filter("conv_id % 2 = 0")
    return c.selectExpr("conv_id grp", "turn + 1 pos", "case (conv_id + turn) % 3 when 0 then 'boundary' when 1 then 'continuation' else 'unsure' end verdict")


@query(
    "q07_spans",
    f"""WITH {CLS}, {VERD}, bd AS (SELECT cl.grp, cl.pos + 1 AS pos FROM cl LEFT JOIN vd ON vd.grp = cl.grp AND vd.pos = cl.pos WHERE cls = 'boundary' OR (cls = 'gray' AND verdict = 'boundary')),
 r AS (SELECT t.grp, t.pos, sum(CASE WHEN bd.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY t.grp ORDER BY t.pos) AS s FROM turns t LEFT JOIN bd ON bd.grp = t.grp AND bd.pos = t.pos) SELECT grp, min(pos) AS first, max(pos) AS last FROM r GROUP BY grp, s""",
)
def q07(spark, sf):
    d = q.decide_gaps(classified(spark, sf), verdicts(spark, sf))
    return q.spans_from_boundaries(tb.turns(spark, sf), d.filter("is_boundary"))


@query("q08_boundary_agreement", f"WITH {CLS}, {mq.SPANS}, st AS (SELECT 'thirds' AS reference, grp, first AS pos FROM sp UNION ALL SELECT 'users', grp, pos FROM turns WHERE role = 'user'), n AS (SELECT cls, count(*) AS n FROM cl GROUP BY 1), g AS (SELECT cls, n, reference FROM n, (SELECT DISTINCT reference FROM st)) SELECT g.cls, g.reference, n, round((SELECT count(*) FROM cl JOIN st ON st.grp = cl.grp AND st.pos = cl.pos + 1 WHERE cl.cls = g.cls AND st.reference = g.reference) / n, 3) AS share FROM g")
def q08(spark, sf):
    st = mq.spans(spark, sf).select(F.lit("thirds").alias("reference"), "grp", F.col("first").alias("pos"))
    st = st.unionByName(tb.turns(spark, sf).filter("role = 'user'").select(F.lit("users").alias("reference"), "grp", "pos"))
    return q.boundary_agreement(classified(spark, sf), st)


def rule_table():
    c = F.col
    gates = [q.Rule("general", c("key").isin("that", "with")), q.Rule("negated", c("subkey").isin("the", "de"), F.length("surface") >= 8, 3, c("subkey").isin("of", "la")), q.Rule("opening", c("surface").rlike("^[A-Z]"), first=2)]
    blockers = [q.Rule("named", c("surface").rlike("^[A-Z]") & (F.length("surface") > 9))]
    frame = [q.Rule("numbered", c("surface").rlike("[0-9]"))]
    return gates, blockers, frame


def turn_clauses(spark, sf):
    t = tb.turns(spark, sf)
    n = F.size(tx.words(F.col("text")))
    c = t.select("grp", "pos", F.posexplode(textops.clause_ranges(F.col("text"), n, ".", "[.?!]")).alias("clause", "c"))
    return c.select("grp", "pos", (F.col("clause") + 1).alias("clause"), "c.first", "c.last")


@query("q09_clause_gates")
def q09(spark, sf):
    t = tb.turn_tokens(spark, sf)
    out = q.clause_gates(t, turn_clauses(spark, sf), *rule_table(), F.col("subkey").isin("and", "und", "et"))
    return out.select("grp", "pos", "clause", F.array_join("gates", ",").alias("gates"), F.array_join("blockers", ",").alias("blockers"), "qualified")


COMP = """cp AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(length(p_name) AS DOUBLE) AS c FROM part), pp AS (SELECT id, (row_number() OVER (ORDER BY a, id) - 1) / (count(*) OVER () - 1) AS pa, (row_number() OVER (ORDER BY b, id) - 1) / (count(*) OVER () - 1) AS pb, (row_number() OVER (ORDER BY c, id) - 1) / (count(*) OVER () - 1) AS pc FROM cp),
 sc AS (SELECT id, round(0.5 * pa + 0.3 * pb + 0.2 * (1 - pc), 9) AS score FROM pp), pl AS (SELECT id, score, (row_number() OVER (ORDER BY score, id) - 1) / (count(*) OVER () - 1) AS place FROM sc)"""


@query("q10_composite_tiers", f"WITH {COMP} SELECT id, score, CASE WHEN place >= 0.95 THEN 0 WHEN place >= 0.7 THEN 1 ELSE 2 END AS tier FROM pl")
def q10(spark, sf):
    p = tb.load(spark, sf, "part").selectExpr("p_partkey id", "cast(p_size as double) a", "p_retailprice b", "cast(length(p_name) as double) c")
    s = q.composite_score(p, "id", {"a": 0.5, "b": 0.3, "c": 0.2}, ["c"])
    return q.global_tiers(s, "id", 0.95, 0.7).select("id", "score", "tier")


@query(
    "q11_threshold_tiers",
    "WITH u AS (SELECT o_custkey AS parent, o_orderkey AS id, count(DISTINCT l_suppkey) AS spread, count(*) AS links FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1,2), b AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY spread DESC, links DESC, id) AS r FROM u) SELECT parent, id, CASE WHEN spread >= 8 THEN 0 WHEN links >= 6 THEN 1 ELSE 2 END AS tier FROM b WHERE r = 1",
)
def q11(spark, sf):
    o, li = tb.load(spark, sf, "orders"), tb.load(spark, sf, "lineitem")
    u = li.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("spread"), F.count(F.lit(1)).alias("links"))
    u = o.join(u, o.o_orderkey == u.l_orderkey).select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("id"), "spread", "links")
    b = q.best_unit(u, "parent", [-F.col("spread"), -F.col("links"), F.col("id")], ["id", "spread", "links"])
    return b.select("parent", "id", q.threshold_tier(F.col("spread"), F.col("links"), F.lit(8), F.lit(6)).alias("tier"))


@query("q12_majority_cluster", f"WITH {gq.LINKS}, n AS (SELECT dst, label AS cluster, count(*) AS n FROM links JOIN uv ON uv.id = src GROUP BY 1,2) SELECT dst, cluster FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY n DESC, cluster) AS r FROM n) WHERE r = 1")
def q12(spark, sf):
    return q.majority_cluster(gq.links(spark, sf), vq.unit(spark, sf).select("id", F.col("label").alias("cluster")))


@query(
    "q13_tag_spans",
    f"WITH {T}, {mq.SPANS}, v AS (SELECT grp, pos, role AS label, 2 AS v FROM turns UNION ALL SELECT grp, pos, 'p' || (length(text) % 4), 1 FROM turns), s AS (SELECT span_id, label, CAST(sum(v) AS BIGINT) AS votes FROM v JOIN sp ON sp.grp = v.grp AND v.pos BETWEEN first AND last GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY votes DESC, label) AS rank, max(votes) OVER (PARTITION BY span_id) AS m FROM s) SELECT span_id, rank, label, votes FROM r WHERE rank = 1 OR (rank = 2 AND votes >= 0.6 * m)",
)
def q13(spark, sf):
    t = tb.turns(spark, sf)
    v = t.select("grp", "pos", F.col("role").alias("label"), F.lit(2).alias("v")).unionByName(t.select("grp", "pos", F.concat(F.lit("p"), F.length("text") % 4).alias("label"), F.lit(1).alias("v")))
    return q.tag_spans(mq.spans(spark, sf), v)


@query("q14_display_score", "SELECT o_custkey AS id, round(least(1.0, (2 * count(*) + 4 * count(DISTINCT o_orderstatus) + 2 * count(DISTINCT o_orderpriority)) / 60), 6) AS score FROM orders GROUP BY 1")
def q14(spark, sf):
    o = tb.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("m"), F.countDistinct("o_orderstatus").alias("t"), F.countDistinct("o_orderpriority").alias("u"))
    return o.select("id", F.round(q.display_score(F.col("m"), F.col("t"), F.col("u")), 6).alias("score"))


@query("q15_select_clauses", "WITH c AS (SELECT l_orderkey AS unit_id, l_linenumber - 1 AS clause, bool_or(l_quantity > 20) AS qualified FROM lineitem GROUP BY 1,2), h AS (SELECT DISTINCT unit_id FROM c WHERE clause > 0 AND qualified) SELECT unit_id, clause FROM c WHERE qualified AND (clause > 0 OR unit_id NOT IN (FROM h))")
def q15(spark, sf):
    c = tb.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id"), (F.col("l_linenumber") - 1).alias("clause")).agg(F.bool_or(F.col("l_quantity") > 20).alias("qualified"))
    return q.select_clauses(c, ["unit_id"]).select("unit_id", "clause")


# --- evaluation ---------------------------------------------------------------------
HALF = "CASE WHEN CAST('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0 THEN 'tune' ELSE 'holdout' END"


@query("e01_hash_split", f"SELECT o_orderkey, {HALF.format(k='o_custkey')} AS half FROM orders")
def e01(spark, sf):
    return tb.load(spark, sf, "orders").select("o_orderkey", ev.half_of(F.col("o_custkey").cast("string")).alias("half"))


@query("e02_every_nth", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 7 = 0")
def e02(spark, sf):
    return ev.every_nth(tb.load(spark, sf, "documents").select("doc_id"), ["doc_id"], 7)


@query("e02_lowest_digests", "SELECT l_orderkey, l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ORDER BY md5(l_orderkey || '|' || l_partkey), l_orderkey, l_partkey LIMIT 300")
def e02b(spark, sf):
    li = tb.load(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return ev.lowest_digests(li, F.concat_ws("|", "l_orderkey", "l_partkey"), 300, "l_orderkey", "l_partkey")


def judged_docs(spark, sf):
    d = tb.load(spark, sf, "documents").join(tb.load(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", (F.col("n_chars") / 200).cast("long").alias("spread"), F.size(F.split("text", "\\n")).cast("long").alias("links"), (F.col("quality") == 1).alias("positive"), (F.col("toxic") == 1).alias("toxic"), ev.half_of(F.col("doc_id").cast("string")).alias("half"))


JD = f"jd AS (SELECT doc_id, CAST(trunc(n_chars / 200) AS BIGINT) AS spread, len(string_split(text, chr(10))) AS links, quality = 1 AS positive, toxic = 1 AS toxic, {HALF.format(k='doc_id')} AS half FROM documents JOIN labels USING (doc_id))"


@query(
    "e03_grid_search",
    f"WITH {JD}, g AS (SELECT t, m FROM (SELECT unnest(generate_series(3, 12))::INTEGER AS t), (SELECT unnest(generate_series(2, 8))::INTEGER AS m)), s AS (SELECT t, m, count(*) FILTER (positive = (spread >= t OR links >= m)) AS score, count(*) AS items FROM jd, g WHERE half = 'tune' GROUP BY 1,2), b AS (SELECT t, m FROM s ORDER BY score DESC, t + m, t, m LIMIT 1) SELECT s.t, s.m, score, items, s.t = b.t AND s.m = b.m AS best FROM s, b",
)
def e03(spark, sf):
    items = judged_docs(spark, sf).filter("half = 'tune'")
    found = (F.col("spread") >= F.col("t")) | (F.col("links") >= F.col("m"))
    return ev.grid_search(items, {"t": range(3, 13), "m": range(2, 9)}, F.col("positive") == found).drop("broken")


@query(
    "e04_kappa",
    f"WITH {JD}, c AS (SELECT count(*) AS n, count(*) FILTER (positive AND links > 10) AS bo, count(*) FILTER (NOT positive AND NOT links > 10) AS ne, count(*) FILTER (positive) AS na, count(*) FILTER (links > 10) AS nb FROM jd), p AS (SELECT *, (bo + ne) / n AS po, na / n * nb / n + (1 - na / n) * (1 - nb / n) AS pe, (bo + (n - bo - ne) / 2) / n AS pm FROM c) SELECT n, bo AS both, ne AS neither, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, round((po - pm * pm - (1 - pm) * (1 - pm)) / (1 - pm * pm - (1 - pm) * (1 - pm)), 6) AS kappa_averaged FROM p".replace("AS both", 'AS "both"'),
)
def e04(spark, sf):
    return ev.kappa(judged_docs(spark, sf).withColumn("other", F.col("links") > 10), "positive", "other")


@query("e04_relation_agreement", f"WITH {gq.LINKS} SELECT count(*) AS \"both\", count(*) FILTER (rel = review_rel) AS same FROM links WHERE review_rel IS NOT NULL AND review IS NOT NULL")
def e04b(spark, sf):
    l = cut_lineage(gq.links(spark, sf))
    return ev.relation_agreement(l.filter("review IS NOT NULL").select("src", "dst", "rel"), l.filter("review_rel IS NOT NULL").select("src", "dst", F.col("review_rel").alias("rel")))


@query("e05_holdout_exam", f"WITH {JD}, h AS (SELECT positive, spread >= 6 AS found FROM jd WHERE half = 'holdout'), s AS (SELECT count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS negatives, avg(CASE WHEN positive THEN found::INT END) AS rc, avg(CASE WHEN NOT positive THEN (NOT found)::INT END) AS rj FROM h) SELECT positives, negatives, round(rc, 6) AS recall, round(rj, 6) AS rejection, rc >= 0.5 AND rj >= 0.5 AS passed FROM s")
def e05(spark, sf):
    h = judged_docs(spark, sf).filter("half = 'holdout'").withColumn("found", F.col("spread") >= 6)
    return ev.holdout_exam(h, 0.5, 0.5)


@query("e06_sensitivity", f"WITH {JD}, m AS (SELECT * FROM (VALUES (5, 4), (7, 4), (6, 3), (6, 5)) v(t, m)), l AS (SELECT doc_id, spread, links, CASE WHEN spread >= 6 THEN 0 WHEN links >= 4 THEN 1 ELSE 2 END AS b FROM jd) SELECT t, m, count(*) FILTER (b <> CASE WHEN spread >= t THEN 0 WHEN links >= m THEN 1 ELSE 2 END) AS flips, count(*) AS total FROM l, m GROUP BY 1,2")
def e06(spark, sf):
    label = lambda t, m: q.threshold_tier(F.col("spread"), F.col("links"), t, m)
    return ev.sensitivity(judged_docs(spark, sf), label, {"t": 6, "m": 4})


@query("e07_build_report", "SELECT 'documents' AS name, count(*) AS got, CAST(NULL AS BIGINT) AS want, TRUE AS ok FROM documents UNION ALL SELECT 'regions', count(*), 5, count(*) = 5 FROM region UNION ALL SELECT 'orphan lines', count(*), 0, count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def e07(spark, sf):
    li, o = tb.load(spark, sf, "lineitem"), tb.load(spark, sf, "orders")
    orphans = li.join(o, li.l_orderkey == o.o_orderkey, "left_anti")
    return ev.build_report([("documents", tb.load(spark, sf, "documents"), None), ("regions", tb.load(spark, sf, "region"), 5), ("orphan lines", orphans, 0)])


@query("e08_consistency", "WITH e AS (SELECT source, count(*) AS entries, count(*) FILTER (lang NOT IN ('en','fr','de')) AS bad_kinds FROM documents GROUP BY 1), v AS (SELECT source, count(*) AS vectors FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1), m AS (SELECT source, count(*) AS count FROM documents GROUP BY 1) SELECT m.source, m.count, entries, bad_kinds, coalesce(vectors, 0) AS vectors, entries = m.count AND coalesce(vectors, 0) = entries AND bad_kinds = 0 AS ok FROM m JOIN e USING (source) LEFT JOIN v USING (source)")
def e08(spark, sf):
    d = tb.load(spark, sf, "documents")
    vec = d.join(tb.load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    man = d.groupBy("source").agg(F.count(F.lit(1)).alias("count"))
    return ev.consistency(d.withColumn("kind", F.col("lang")), vec, man, ["en", "fr", "de"])


@query("e09_tiling_coverage", f"WITH {T}, {mq.SPANS}, z AS (SELECT grp, count(*) AS size FROM turns GROUP BY 1) SELECT z.grp, size, CAST(coalesce(sum(last - first + 1), 0) AS BIGINT) AS covered, coalesce(sum(last - first + 1), 0) = size AS whole FROM z LEFT JOIN sp ON sp.grp = z.grp AND first > 1 GROUP BY 1, 2")
def e09(spark, sf):
    z = tb.turns(spark, sf).groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    return ev.tiling_coverage(mq.spans(spark, sf).filter("first > 1"), z)


BAT = "wb AS (SELECT grp, n, CAST(coalesce(sum(n) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100 AS BIGINT) AS batch FROM (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1))"


def batches(spark, sf):
    return ev.work_batches(tb.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.count(F.lit(1)).alias("n")))


@query("e10_work_batches", f"WITH {BAT} SELECT grp, n, batch FROM wb")
def e10(spark, sf):
    return batches(spark, sf)


@query("e10_waves", f"WITH {BAT}, d AS (SELECT DISTINCT batch FROM wb), o AS (SELECT batch, row_number() OVER (ORDER BY md5('w' || batch), batch) - 1 AS i, CAST(ceil(count(*) OVER () / 9) AS BIGINT) AS w FROM d) SELECT batch, i // w AS swarm, (i // w) // 3 AS wave, i % w < ceil(w * 0.05) AS repeated FROM o")
def e10b(spark, sf):
    return ev.waves(cut_lineage(batches(spark, sf)))


@query("e11_missing_ids", "SELECT i AS id FROM (SELECT unnest(generate_series(0, (SELECT max(doc_id) FROM documents)))::BIGINT AS i) WHERE i NOT IN (SELECT doc_id FROM labels)")
def e11(spark, sf):
    top = tb.load(spark, sf, "documents").agg((F.max("doc_id") + 1).alias("n")).first()[0]
    return ev.missing_ids(tb.load(spark, sf, "labels").select(F.col("doc_id").alias("id")), spark.range(top))


@query("e11_missing_runs", "WITH m AS (SELECT i, i - row_number() OVER (ORDER BY i) AS k FROM (SELECT unnest(generate_series(0, (SELECT max(doc_id) FROM documents)))::BIGINT AS i) WHERE i NOT IN (SELECT doc_id FROM labels)) SELECT min(i) AS first, max(i) AS last, count(*) AS n FROM m GROUP BY k")
def e11b(spark, sf):
    return ev.missing_runs(e11(spark, sf))


@query("e12_tallies", "SELECT CAST(o_custkey % 20 AS BIGINT) AS batch, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) AS total FROM orders GROUP BY ROLLUP (1)")
def e12(spark, sf):
    return ev.tallies(tb.load(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("batch"), F.col("o_orderstatus").alias("verdict")), ["F", "O"])


@query("e13_lost_pairs", "WITH p AS (SELECT DISTINCT l_returnflag AS f, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem) SELECT a, b FROM p WHERE f = 'A' AND (a, b) IN (SELECT (a, b) FROM p WHERE f = 'N') AND (a, b) NOT IN (SELECT (a, b) FROM p WHERE f = 'R')")
def e13(spark, sf):
    p = tb.load(spark, sf, "lineitem").select("l_returnflag", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return ev.lost_pairs(*[p.filter(F.col("l_returnflag") == f).select("a", "b") for f in "ANR"])
