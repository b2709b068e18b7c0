"""Pair, alignment and audit operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.scale import kept, ordinal, scratch_path, spread
from corpusloom.operators import align, audit, pairs, search, textops, vectors
from corpusloom.plans import tables as tb
from corpusloom.plans import text_queries as tq
from corpusloom.plans import vector_queries as vq
from corpusloom.plans.registry import ORACLES, query

B, U, D, T, TT = tb.BASKET, tb.BASKET_UNITS, tb.DOC_TOK, tb.TURNS, tb.TURN_TOK

EDGES = "edges AS (SELECT x.key AS a, y.key AS b, count(*) AS weight FROM (SELECT DISTINCT unit_id, key FROM tok) x JOIN (SELECT DISTINCT unit_id, key FROM tok) y ON x.unit_id = y.unit_id AND x.key < y.key GROUP BY 1,2)"


def basket_edges(spark, sf, floor=3):
    li = tb.basket(spark, sf).select("unit_id", "key")
    return pairs.cooccurrence(li, floor)


@query("c01_cooccurrence", f"WITH {B}, {EDGES} SELECT a, b, weight FROM edges WHERE weight >= 3 ORDER BY weight DESC, a, b LIMIT 30")
def c01(spark, sf):
    return basket_edges(spark, sf).orderBy(F.desc("weight"), "a", "b").limit(30)


@query("c01_cooccurrence_words", f"WITH {TT}, d AS (SELECT DISTINCT grp || ':' || pos AS u, subkey FROM ttok WHERE subkey IS NOT NULL), o AS (SELECT subkey FROM d GROUP BY 1 HAVING count(*) >= 12), e AS (SELECT * FROM d WHERE subkey IN (FROM o)) SELECT x.subkey AS a, y.subkey AS b, count(*) AS weight FROM e x JOIN e y ON x.u = y.u AND x.subkey < y.subkey GROUP BY 1,2 HAVING count(*) >= 12")
def c01b(spark, sf):
    t = tb.turn_tokens(spark, sf).select(tb.pair_id("grp", "pos").alias("unit_id"), "subkey")
    return pairs.cooccurrence(t, 12, key="subkey", cell=256)


@query("c02_partners", f"WITH {B}, {EDGES}, p AS (SELECT b AS key, weight AS shared FROM edges WHERE a = 'Brand#7' UNION ALL SELECT a, weight FROM edges WHERE b = 'Brand#7') SELECT key, shared FROM p WHERE shared >= 60 ORDER BY shared DESC, key LIMIT 20")
def c02(spark, sf):
    return pairs.partners(tb.basket(spark, sf), "Brand#7", 60, 20)


@query("c03_neighbour_lists", f"WITH {B}, {EDGES}, e AS (SELECT a AS node, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges) SELECT node, other, weight FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS r FROM e) WHERE r <= 5")
def c03(spark, sf):
    return pairs.neighbour_lists(basket_edges(spark, sf, 1), "weight", 5)


@query("c04_bipartite_edges", f"WITH {B} SELECT 'r' || key AS source, 'l' || subkey AS target, count(*) AS weight FROM tok GROUP BY 1,2")
def c04(spark, sf):
    return pairs.bipartite(tb.basket(spark, sf), tb.load(spark, sf, "part").select(F.col("p_brand").alias("key")).distinct())[1]


@query("c04_bipartite_nodes", f"WITH {B} SELECT DISTINCT 'r' || p_brand AS id, p_brand AS label, 'key' AS type FROM part UNION ALL SELECT DISTINCT 'l' || subkey, CAST(subkey AS VARCHAR), 'subkey' FROM tok")
def c04b(spark, sf):
    return pairs.bipartite(tb.basket(spark, sf), tb.load(spark, sf, "part").select(F.col("p_brand").alias("key")).distinct())[0]


@query("c05_threshold_networks", f"WITH {B}, {EDGES}, t AS (SELECT unnest([60,80,90]) AS floor), e AS (SELECT floor, a, b, weight FROM edges, t WHERE weight >= floor), n AS (SELECT floor, a AS node, weight FROM e UNION ALL SELECT floor, b, weight FROM e) SELECT floor, node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM n GROUP BY 1,2")
def c05(spark, sf):
    return pairs.threshold_networks(basket_edges(spark, sf), [60, 80, 90])[1]


def doc_seqs(spark, sf):
    d = spread(tb.load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("unit_id"), "text", tx.folded_words(F.col("text")).alias("w"))
    seq = F.transform("w.fold", lambda f: F.when(f == "", align.MISSING).otherwise(f))
    return d.select("unit_id", "text", F.col("w.surface").alias("surf"), seq.alias("seq"))


SEQ = f"""ds AS (SELECT doc_id AS unit_id, text, surf, list_transform(surf, lambda w: coalesce(nullif({tb.fold_sql('w')}, ''), '-1')) AS seq FROM (SELECT doc_id, text, {tb.words_sql('text')} AS surf FROM documents)),
 gm AS MATERIALIZED (SELECT DISTINCT unit_id, unnest(list_transform(generate_series(1, len(seq) - 3), lambda i: concat_ws(',', seq[i], seq[i+1], seq[i+2], seq[i+3]))) AS gram FROM ds WHERE len(seq) >= 4),
 gd AS (SELECT gram FROM gm GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60), gc AS MATERIALIZED (SELECT * FROM gm WHERE gram IN (FROM gd)),
 cand AS MATERIALIZED (SELECT x.unit_id AS a, y.unit_id AS b, count(*) AS shared FROM gc x JOIN gc y ON x.gram = y.gram AND x.unit_id < y.unit_id GROUP BY 1,2 HAVING count(*) >= 2)"""


@query("c06_gram_candidates", f"WITH {SEQ} SELECT a, b, shared FROM cand")
def c06(spark, sf):
    return pairs.gram_candidates(doc_seqs(spark, sf))


JAC = """gn AS (SELECT unit_id, count(*) AS n FROM gm GROUP BY 1), ji AS (SELECT a, b, count(*) AS i FROM cand JOIN gm x ON x.unit_id = a JOIN gm y ON y.unit_id = b AND y.gram = x.gram GROUP BY 1,2),
 jac AS (SELECT a, b, i / (p.n + q.n - i) AS jac FROM ji JOIN gn p ON p.unit_id = a JOIN gn q ON q.unit_id = b)"""


@query("c07_gram_jaccard", f"WITH {SEQ}, {JAC} SELECT a, b, round(jac, 6) AS jaccard FROM jac")
def c07(spark, sf):
    s = doc_seqs(spark, sf)
    return pairs.overlapping_pairs(s).select("a", "b", F.round("jac", 6).alias("jaccard"))


def turn_seqs(spark, sf):
    """Turns as units, numbered in conversation order from 0."""
    c = tb.load(spark, sf, "conversations")
    c = ordinal(c.select("conv_id", "turn", "text"), ["conv_id", "turn"], out="n")
    d = c.select((F.col("n") - 1).alias("unit_id"), "text", tx.folded_words(F.col("text")).alias("w"))
    seq = F.transform("w.fold", lambda f: F.when(f == "", align.MISSING).otherwise(f))
    return kept(d.select("unit_id", "text", F.col("w.surface").alias("surf"), seq.alias("seq")), "turn-seqs")  # read by several steps


TSEQ = SEQ.replace("doc_id AS unit_id", "unit_id").replace("SELECT doc_id, text", "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS unit_id, text").replace("FROM documents", "FROM conversations")

# runs over 4-gram places: every candidate shares a 4-gram, so no longer run is missed
RUN = """gp AS MATERIALIZED (SELECT unit_id, unnest(gs) AS gram, generate_subscripts(gs,1) AS i FROM (SELECT unit_id, list_transform(generate_series(1, len(seq) - 3), lambda i: CASE WHEN list_contains([seq[i], seq[i+1], seq[i+2], seq[i+3]], '-1') THEN NULL ELSE concat_ws(',', seq[i], seq[i+1], seq[i+2], seq[i+3]) END) AS gs FROM ds WHERE len(seq) >= 4)),
 mt AS (SELECT a, b, x.i, y.i - x.i AS d FROM cand JOIN gp x ON x.unit_id = a JOIN gp y ON y.unit_id = b AND y.gram = x.gram),
 il AS (SELECT a, b, d, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS g FROM mt),
 rn AS (SELECT a, b, max(n) + 3 AS run FROM (SELECT a, b, d, g, count(*) AS n FROM il GROUP BY ALL) GROUP BY 1,2)"""


@query("c08_longest_run", f"WITH {TSEQ}, {RUN} SELECT a, b, CAST(run AS INTEGER) AS run FROM rn")
def c08(spark, sf):
    s = turn_seqs(spark, sf)
    p = pairs.with_sequences(pairs.gram_candidates(s), s, "seq")
    return align.with_longest_run(p, "a_seq", "b_seq").filter("run >= 4").select("a", "b", "run")


SEM = """sem AS MATERIALIZED (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, x.score AS cos FROM knn x JOIN knn y ON x.id = y.other AND x.other = y.id AND x.id < y.id)"""


def semantic_pairs(spark, sf):
    return vectors.mutual_pairs(vq.knn(spark, sf)).select("a", "b", F.col("score").alias("cos"))


@query(
    "c09_tiers",
    f"""WITH {tb.VEC}, knn AS (SELECT id, other, score FROM (SELECT x.id, y.id AS other, round(list_dot_product(x.vec, y.vec), 6) AS score, row_number() OVER (PARTITION BY x.id ORDER BY round(list_dot_product(x.vec, y.vec), 6) DESC, y.id) AS r FROM vecs x JOIN vecs y ON x.id <> y.id WHERE round(list_dot_product(x.vec, y.vec), 6) >= 0.2) WHERE r <= 20),
 {SEM}, {TSEQ}, alls AS (SELECT a, b, shared, cos FROM cand FULL JOIN sem USING (a, b)),
 gn AS (SELECT unit_id, count(*) AS n FROM gm GROUP BY 1), ji AS (SELECT a, b, count(*) AS i FROM alls JOIN gm x ON x.unit_id = a JOIN gm y ON y.unit_id = b AND y.gram = x.gram GROUP BY 1,2), {RUN.replace('FROM cand', 'FROM alls')},
 f AS (SELECT a, b, coalesce(i / (p.n + q.n - i), 0) AS jac, coalesce(run, 0) AS run, cos, x.text = y.text AS same FROM alls LEFT JOIN ji USING (a, b) LEFT JOIN gn p ON p.unit_id = a LEFT JOIN gn q ON q.unit_id = b LEFT JOIN rn USING (a, b) JOIN ds x ON x.unit_id = a JOIN ds y ON y.unit_id = b),
 t AS (SELECT *, CASE WHEN same THEN 'exact' WHEN jac >= 0.45 THEN 'near' WHEN run >= 5 THEN 'phrase' WHEN coalesce(cos, 0) >= 0.62 AND jac < 0.2 THEN 'paraphrase' END AS tier FROM f)
 SELECT a, b, tier, round(jac, 3) AS jaccard, CAST(CASE WHEN run >= 4 THEN run END AS INTEGER) AS run, round(cos, 3) AS cos FROM t WHERE tier IS NOT NULL""",
)
def c09(spark, sf):
    s = turn_seqs(spark, sf)
    t = pairs.tier_pairs(pairs.gram_candidates(s), semantic_pairs(spark, sf), s)
    return t.withColumn("run", F.when(F.col("run") >= 4, F.col("run")))


def lexical_tiers(spark, sf):
    s = turn_seqs(spark, sf)
    none = spark.createDataFrame([], "a long, b long, cos double")
    return s, pairs.tier_pairs(pairs.gram_candidates(s), none, s)


@query("c10_alignment")
def c10(spark, sf):
    s, t = lexical_tiers(spark, sf)
    out = align.with_alignment(pairs.with_sequences(t, s, "seq", "surf"))
    return align.op_counts(out, ["a", "b"]).select("a", "b", "tier", "n_eq", "n_frm", "n_del", "n_ins", "moved")


@query("c11_window_alignment")
def c11(spark, sf):
    s, t = lexical_tiers(spark, sf)
    out = align.with_window_alignment(pairs.with_sequences(t.filter("tier = 'phrase'"), s, "seq", "surf"))
    return out.filter("win IS NOT NULL").select("a", "b", "win.side", "win.pre", "win.post", "win.matched", F.size("win.ops").alias("n_ops"))


@query("c12_classes")
def c12(spark, sf):
    s, t = lexical_tiers(spark, sf)
    out = align.op_counts(align.with_alignment(pairs.with_sequences(t, s, "seq", "surf")), ["a", "b"])
    return out.select("a", "b", align.classify().alias("cat"), F.round(align.eq_share(), 4).alias("eq"))


FORM = """core AS (SELECT a, b, arg_min(gram, o) AS gram, max(n) + 3 AS run FROM (SELECT a, b, first_i AS o, n, gram FROM (SELECT a, b, d, g, count(*) AS n, min(i) AS first_i, arg_min(gram, i) AS gram, max(count(*)) OVER (PARTITION BY a, b) AS best
  FROM (SELECT a, b, d, i, gram, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS g FROM (SELECT a, b, x.i, x.gram, y.i - x.i AS d FROM cand JOIN gp x ON x.unit_id = a JOIN gp y ON y.unit_id = b AND y.gram = x.gram)) GROUP BY a, b, d, g) WHERE n = best) GROUP BY 1,2)"""


@query("c13_formula_cores", f"WITH {TSEQ}, {RUN}, {FORM} SELECT a, b, CAST(core.run AS INTEGER) AS run, core.gram FROM core WHERE gram IN (SELECT gram FROM gm GROUP BY 1 HAVING count(*) >= 3)")
def c13(spark, sf):
    s = turn_seqs(spark, sf)
    p = align.with_longest_run(pairs.with_sequences(pairs.gram_candidates(s), s, "seq"), "a_seq", "b_seq").filter("run >= 4")
    p = p.select("a", "b", "run", F.concat_ws(",", F.slice("a_seq", F.col("run_at") + 1, 4)).alias("gram"))
    df = pairs.gram_table(s).groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df >= 3")
    return p.join(df, "gram", "left_semi")


@query("c14_diff_catalog")
def c14(spark, sf):
    s, t = lexical_tiers(spark, sf)
    return align.diff_catalog(t, s).select("a", "b", "tier", "cat", "dropped", F.round("eq", 4).alias("eq"), "moved", "morph", "shifted", "win_side")


def near_copies(spark, sf):
    """Identical and near-identical documents, with a digest of both texts."""
    s = doc_seqs(spark, sf)
    p = pairs.overlapping_pairs(s.withColumn("digest", F.md5("text")), "digest", floor=0.45)  # identical ones have 1
    cat = F.when(F.col("a_digest") == F.col("b_digest"), "identical").otherwise("near")
    return s, p.select("a", "b", cat.alias("cat"), "a_digest", "b_digest")


@query("c15_rebuilt_sides", f"WITH {SEQ}, {JAC} SELECT a, b, md5(array_to_string(x.surf, ' ')) AS ha, md5(array_to_string(y.surf, ' ')) AS hb FROM jac JOIN ds x ON x.unit_id = a JOIN ds y ON y.unit_id = b WHERE x.text = y.text OR jac >= 0.45")
def c15(spark, sf):
    s, p = near_copies(spark, sf)
    p, key = kept(p, "near-copies"), ["a_digest", "b_digest"]
    # sides depend on texts alone, so copies of a pair of texts are aligned once
    once = kept(p.groupBy(*key).agg(F.min(F.struct("a", "b")).alias("p")).select(*key, "p.*"), "text-pairs")
    near = s.join(once.select(F.explode(F.array("a", "b")).alias("unit_id")).distinct(), "unit_id", "left_semi")
    out = align.rebuilt_sides(align.with_alignment(pairs.with_sequences(once, near, "seq", "surf")))
    out = kept(out.select(*key, F.md5("side_a").alias("ha"), F.md5("side_b").alias("hb")), "rebuilt")
    return p.join(out, key).select("a", "b", "ha", "hb")


def line_units(spark, sf):
    """Sentences of the turns as units: many short copies, ordered inside a conversation."""
    t = tb.turns(spark, sf)
    s = t.select("grp", "pos", F.posexplode(F.filter(F.split(F.col("text"), "[.\\n]"), lambda x: F.trim(x) != "")).alias("i", "s"))
    s = ordinal(s, ["pos", "i"], ["grp"], "place")
    s = s.select("grp", F.col("place").alias("pos"), F.filter(F.transform(tx.words(F.col("s")), lambda w: tx.fold(w, "latin")), lambda w: w != "").alias("seq"))
    return s.withColumn("unit_id", tb.pair_id("grp", "pos")).withColumn("theme", F.col("grp") % 7)


LINES = f"""ln AS (SELECT grp, place AS pos, grp || ':' || place AS unit_id, grp % 7 AS theme, list_filter(list_transform({tb.words_sql('s')}, lambda w: {tb.fold_sql('w')}), lambda w: w <> '') AS seq FROM
 (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos, i) AS place FROM (SELECT grp, pos, unnest(ss) AS s, generate_subscripts(ss,1) AS i FROM (SELECT conv_id AS grp, turn + 1 AS pos, list_filter(string_split_regex(text, '[.\\n]'), lambda x: trim(x) <> '') AS ss FROM conversations))))"""


@query(
    "c16_unit_twins",
    f"""WITH {LINES}, w AS MATERIALIZED (SELECT DISTINCT unit_id, n, unnest(list_transform(generate_series(1, len(seq) - n + 1), lambda i: array_to_string(seq[i:i+n-1], ','))) AS g FROM ln, (SELECT unnest(generate_series(4, 12)) AS n) WHERE len(seq) >= n),
 tw AS (SELECT x.unit_id, y.unit_id AS other FROM ln x JOIN w y ON y.n = len(x.seq) AND y.g = array_to_string(x.seq, ',') WHERE len(x.seq) BETWEEN 4 AND 12
  UNION SELECT x.unit_id, y.unit_id FROM ln l JOIN w x ON x.unit_id = l.unit_id AND x.n = 12 JOIN w y ON y.n = 12 AND y.g = x.g WHERE len(l.seq) > 12),
 ok AS (SELECT tw.unit_id, other, o.theme FROM tw JOIN ln u ON u.unit_id = tw.unit_id JOIN ln o ON o.unit_id = other WHERE tw.unit_id <> other AND NOT (u.grp = o.grp AND abs(u.pos - o.pos) <= 2)),
 c AS (SELECT unit_id, count(*) AS n, count(DISTINCT theme) AS s FROM ok GROUP BY 1)
 SELECT l.unit_id, CAST(coalesce(n, 0) AS BIGINT) AS n_twins, CAST(coalesce(s, 0) AS BIGINT) AS twin_spread, len(seq) <= 5 AND coalesce(n, 0) >= 8 AS is_formula FROM ln l LEFT JOIN c ON c.unit_id = l.unit_id""",
)
def c16(spark, sf):
    u = line_units(spark, sf)
    return pairs.twin_counts(u.select("unit_id", "grp", "pos", "theme"), u.select("unit_id", "seq"))


RARE = """kn AS (SELECT subkey AS key, count(*) AS n FROM ttok WHERE subkey IS NOT NULL GROUP BY 1), ks AS (SELECT DISTINCT grp || ':' || pos AS u, key, n < 6 AS rare FROM (SELECT grp, pos, subkey AS key FROM ttok WHERE subkey IS NOT NULL) JOIN kn USING (key))"""


def turn_keys(spark, sf):
    t = tb.turn_tokens(spark, sf).select(tb.pair_id("grp", "pos").alias("unit_id"), F.col("subkey").alias("key"))
    occ = t.dropna(subset=["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return pairs.key_sets(t, occ, 6)


@query(
    "c17_containment",
    f"""WITH {TT}, {RARE}, p AS (SELECT DISTINCT x.u AS a, y.u AS b FROM ks x JOIN ks y ON x.key = y.key AND x.u < y.u WHERE x.rare), z AS (SELECT u, count(*) AS s FROM ks WHERE rare GROUP BY 1),
 h AS (SELECT a, b, (SELECT count(*) FROM ks x JOIN ks y ON y.key = x.key AND y.u = b WHERE x.u = a AND x.rare) AS i, (SELECT count(*) FROM ks x JOIN ks y ON y.key = x.key AND y.u = a WHERE x.u = b AND x.rare) AS j FROM p)
 SELECT a, b, round(i / p.s, 6) AS c_ab, round(j / q.s, 6) AS c_ba FROM h LEFT JOIN z p ON p.u = a LEFT JOIN z q ON q.u = b""",
)
def c17(spark, sf):
    k = turn_keys(spark, sf)
    r = k.filter("rare")
    p = r.select(F.col("unit_id").alias("a"), "key").join(r.select(F.col("unit_id").alias("b"), "key"), "key").filter("a < b").select("a", "b").distinct()
    return pairs.containment(p, k).select("a", "b", F.round("c_ab", 6).alias("c_ab"), F.round("c_ba", 6).alias("c_ba"))


@query("c18_rare_key_candidates", f"WITH {TT}, {RARE}, s AS (SELECT x.u AS hub, y.u AS cand, count(*) AS shared FROM ks x JOIN ks y ON x.key = y.key AND x.u <> y.u WHERE x.rare GROUP BY 1,2) SELECT hub, cand, shared FROM (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY shared DESC, cand) AS r FROM s) WHERE r <= 6")
def c18(spark, sf):
    k = turn_keys(spark, sf)
    hubs = tb.turns(spark, sf).select(tb.pair_id("grp", "pos").alias("unit_id"))
    return pairs.rare_key_candidates(hubs, k, 6)


@query(
    "c19_fused_candidates",
    f"""WITH {vq.knn_sql(40, -1)}, fw AS (SELECT id AS hub, other AS cand, score, 0 AS ch, -score AS o FROM knn WHERE rank <= 12 AND score >= 0.2 AND score < 0.95), rv AS (SELECT other AS hub, id AS cand, score, 1 AS ch, -score AS o FROM knn WHERE rank <= 12 AND score >= 0.2 AND score < 0.95),
 kk AS (SELECT l_orderkey % (SELECT count(*) FROM embeddings) AS u, l_partkey AS key FROM lineitem GROUP BY 1, 2), ra AS (SELECT key FROM kk GROUP BY 1 HAVING count(*) < 40), rk AS (SELECT * FROM kk WHERE key IN (FROM ra)), sh AS (SELECT hub, cand, shared FROM (SELECT x.u AS hub, y.u AS cand, count(*) AS shared, row_number() OVER (PARTITION BY x.u ORDER BY count(*) DESC, y.u) AS r FROM rk x JOIN rk y ON x.key = y.key AND x.u <> y.u GROUP BY 1, 2) WHERE r <= 16),
 rt AS (SELECT hub, cand, score, 2 AS ch, -CAST(shared AS DOUBLE) AS o FROM sh JOIN sims ON sims.id = hub AND sims.other = cand WHERE score < 0.95),
 al AS (SELECT * FROM (SELECT * FROM fw UNION ALL SELECT * FROM rv UNION ALL SELECT * FROM rt) JOIN uv p ON p.id = hub JOIN uv q ON q.id = cand WHERE NOT (p.label = q.label AND abs(p.id - q.id) <= 2)),
 fi AS (SELECT hub, cand, ch, o, score FROM (SELECT *, row_number() OVER (PARTITION BY hub, cand ORDER BY ch, o, score) AS r FROM al) WHERE r = 1), li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hub, ch ORDER BY o, cand) AS r8 FROM fi) WHERE ch < 2 OR r8 <= 8)
 SELECT hub, cand, CASE ch WHEN 0 THEN 'fwd' WHEN 1 THEN 'rev' ELSE 'root' END AS via, score FROM (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY ch, o, cand) AS k FROM li) WHERE k <= 30""",
)
def c19(spark, sf):
    u = vq.unit(spark, sf)
    t = vectors.cut_lineage(vectors.knn(u, 12))
    fwd = t.select(F.col("id").alias("hub"), F.col("other").alias("cand"), "score")
    rev = t.select(F.col("other").alias("hub"), F.col("id").alias("cand"), "score")
    n = tb.load(spark, sf, "embeddings").count()  # every order stands for one of the vectors
    k = tb.load(spark, sf, "lineitem").select((F.col("l_orderkey") % n).alias("unit_id"), F.col("l_partkey").alias("key")).distinct()
    keys = pairs.key_sets(k, k.groupBy("key").agg(F.count(F.lit(1)).alias("n")), 40)
    shared = pairs.rare_key_candidates(k.select("unit_id"), keys, 16)
    return pairs.fuse_candidates(fwd, rev, shared, u.select("id", "vec"), vq.place(u), floor=0.2)


@query(
    "c20_link_quotations",
    f"""WITH q AS (SELECT item_id || ':' || i AS quote_id, q FROM (SELECT item_id, unnest(ss) AS q, generate_subscripts(ss,1) AS i FROM (SELECT item_id, string_split_regex(text, '[.,]') AS ss FROM benchmark))),
 qs AS (SELECT quote_id, trim(regexp_replace(translate(regexp_replace(lower(q), '[^a-z0-9 \\n]+', '', 'g'), 'x', 'x'), '{tb.SP}', ' ', 'g')) AS q FROM q),
 us AS (SELECT doc_id AS unit_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 \\n]+', '', 'g'), '{tb.SP}', ' ', 'g')) AS t FROM documents),
 h AS (SELECT quote_id, unit_id FROM qs JOIN us ON contains(t, q) WHERE length(q) >= 8 AND contains(q, ' ')) SELECT quote_id, unit_id FROM h WHERE quote_id IN (SELECT quote_id FROM h GROUP BY 1 HAVING count(*) <= 10)""",
)
def c20(spark, sf):
    skeleton = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 \\n]+", ""), tx.SPACE, " "))
    q = tb.load(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "[.,]")).alias("i", "quote"))
    q = q.select(tb.pair_id("item_id", F.col("i") + 1).alias("quote_id"), "quote")
    u = spread(tb.load(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), "text"), "unit_id")
    return audit.link_quotations(q, u, skeleton)


def answers(spark, sf):
    """Each turn as an answer that quotes its own text or the turn before, with numbers."""
    c = tb.load(spark, sf, "conversations")
    ev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    a = c.join(ev, ["conv_id", "turn"])
    quoted = F.when(F.col("conv_id") % 2 == 0, F.col("before")).otherwise(F.col("text"))
    text = F.concat(F.lit("«"), F.regexp_replace(quoted, "»", ""), F.lit("» [p 99] 12:40 "), (F.col("turn") * 7 + F.col("conv_id") % 3).cast("string"), F.lit(" x"))
    aid = tb.pair_id("conv_id", "turn")
    ans = a.select(aid.alias("answer_id"), text.alias("text"))
    evid = a.select(aid.alias("answer_id"), F.concat(F.col("before"), F.lit(" "), F.col("turn") * 7, F.lit(" ")).alias("text"))
    return ans, evid


@query(
    "c21_audit_claims",
    f"""WITH a AS (SELECT c.conv_id || ':' || c.turn AS answer_id, replace(CASE WHEN c.conv_id % 2 = 0 THEN p.text ELSE c.text END, '»', '') AS quoted, c.turn * 7 + c.conv_id % 3 AS num, p.text || ' ' || c.turn * 7 || ' ' AS known
  FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn + 1 = c.turn),
 cl AS (SELECT DISTINCT answer_id, known, trim(regexp_replace(unnest(string_split_regex(quoted, '…|[.][.][.]')), '{tb.SP}', ' ', 'g')) AS claim FROM a WHERE length(quoted) >= 25),
 pl AS (SELECT answer_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('«' || quoted || '» [p 99] 12:40 ' || num || ' x', '([0-9])[,،٬]([0-9])', '\\1\\2', 'g'), '[0-9]{{1,3}}:[0-9]{{1,3}}', ' ', 'g'), '\\[[^\\]]{{0,40}}\\]', ' ', 'g'), '(?m)^[ \\t]*[0-9]{{1,2}}[.)][ \\t]', ' ', 'g') AS t FROM a),
 sd AS (SELECT DISTINCT answer_id, TRY_CAST(unnest(regexp_extract_all(t, '[0-9]+')) AS DECIMAL(38,0)) AS v FROM pl),
 kn AS (SELECT DISTINCT answer_id, TRY_CAST(unnest(regexp_extract_all(known, '[0-9]+')) AS DECIMAL(38,0)) AS v FROM a)
 SELECT answer_id, 'citation' AS kind, claim FROM cl WHERE length(claim) >= 15 AND NOT contains(trim(regexp_replace(known, '{tb.SP}', ' ', 'g')), claim)
 UNION ALL SELECT answer_id, 'number', CAST(v AS VARCHAR) FROM sd WHERE v >= 11 AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.answer_id = sd.answer_id AND kn.v = sd.v)""",
)
def c21(spark, sf):
    return audit.audit_claims(*answers(spark, sf))


@query(
    "c22_audit_style",
    """WITH t AS (SELECT conv_id || ':' || turn AS answer_id, text AS own FROM conversations), v AS (SELECT answer_id, regexp_matches(own, 'of the (and|on)|que la') AS f, contains(own, 'ention') AND NOT regexp_matches(own, '[0-9]') AS n, contains(own, 'ention') AND NOT regexp_matches(own, 'may|from|with') AS h FROM t)
 SELECT answer_id, concat_ws(';', CASE WHEN f THEN 'forbidden' END, CASE WHEN n THEN 'lacks numbers' END, CASE WHEN h THEN 'lacks hedge' END) AS violations FROM v WHERE f OR n OR h""",
)
def c22(spark, sf):
    a = tb.load(spark, sf, "conversations").select(tb.pair_id("conv_id", "turn").alias("answer_id"), "text")
    v = audit.audit_style(a, "of the (and|on)|que la", "ention", {"numbers": "[0-9]", "hedge": "may|from|with"})
    return v.select("answer_id", F.array_join("violations", ";").alias("violations"))


@query("c23_nearest_keys")
def c23(spark, sf):
    return textops.nearest_keys(tq.forms(spark, sf), tq.keys(spark, sf))


@query(
    "c24_phrase_patterns",
    f"""WITH {TT}, n AS (SELECT *, lead(subkey) OVER (PARTITION BY grp, pos ORDER BY tok_no) AS nx FROM ttok),
 f AS (SELECT grp, pos, coalesce(bool_or(key = 'that'), false) AND coalesce(bool_or(key = 'with'), false) AS p, coalesce(bool_or(subkey = 'of' AND coalesce(nx NOT IN ('the','on'), true)), false) OR bool_or(starts_with(surface, 'Thha')) AS s FROM n GROUP BY 1,2)
 SELECT grp, pos, CASE WHEN p THEN 'parable' ELSE 'simile' END AS kind FROM f WHERE p OR s""",
)
def c24(spark, sf):
    return audit.phrase_patterns(tb.turn_tokens(spark, sf), ["grp", "pos"], ("that", "with"), "of", ["the", "on"], "Thha")


@query(
    "c25_full_text_search",
    f"""WITH {D}, q AS (SELECT DISTINCT item_id AS qid, {tb.fold_sql('w')} AS term FROM (SELECT item_id, unnest({tb.words_sql('text')}) AS w FROM benchmark) WHERE {tb.fold_sql('w')} <> ''),
 l AS (SELECT unit_id, count(*) AS len FROM tok WHERE subkey IS NOT NULL GROUP BY 1), p AS (SELECT subkey AS term, unit_id, count(*) AS tf FROM tok WHERE subkey IS NOT NULL GROUP BY 1,2), s AS (SELECT count(*) AS n, avg(len) AS av FROM l),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), w AS (SELECT qid, count(*) AS want FROM q GROUP BY 1),
 r AS (SELECT qid, p.unit_id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)) AS sc FROM q JOIN p ON p.term = q.term JOIN df ON df.term = q.term JOIN l ON l.unit_id = p.unit_id, s),
 g AS (SELECT qid, unit_id, round(sum(sc), 6) AS score, count(*) AS hits FROM r GROUP BY 1,2)
 SELECT qid, unit_id, score FROM (SELECT g.*, row_number() OVER (PARTITION BY g.qid ORDER BY score DESC, unit_id) AS k FROM g JOIN w ON w.qid = g.qid AND hits = want) WHERE k <= 10""",
)
def c25(spark, sf):
    b = tb.load(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(tx.words(F.col("text"))).alias("w"))
    q = b.select("qid", tx.fold(F.col("w"), "latin").alias("term")).filter("term <> ''").distinct()
    return audit.text_search(q, tb.doc_folds(spark, sf), 10)


def corpus_index(spark, sf):
    """The index of the documents, built once per run."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = scratch_path(spark, "index")
        search.build_index(tb.doc_tokens(spark, sf).select("unit_id", F.col("tok_no").alias("place"), F.col("subkey").alias("term")), _INDEXES[key], unit_block=64)
    return search.Index(spark, _INDEXES[key])


_INDEXES: dict[tuple[str, str], str] = {}


def benchmark_terms(spark, sf):
    b = tb.load(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(tx.words(F.col("text"))).alias("nth", "w"))
    return b.select("qid", "nth", tx.fold(F.col("w"), "latin").alias("term")).filter("term <> ''")


@query("c25_index_search", ORACLES["c25_full_text_search"])
def c25_index(spark, sf):
    return corpus_index(spark, sf).search(benchmark_terms(spark, sf), 10)


@query(
    "c25_index_phrases",
    f"""WITH {D}, w AS (SELECT item_id AS qid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS nth FROM (SELECT item_id, {tb.words_sql('text')} AS ws FROM benchmark)), q AS (SELECT qid, nth - 2 AS nth, {tb.fold_sql('w')} AS term FROM w WHERE nth BETWEEN 2 AND 5 AND {tb.fold_sql('w')} <> ''), n AS (SELECT qid, count(*) AS want FROM q GROUP BY 1),
 v AS (SELECT q.qid, t.unit_id, t.tok_no - q.nth AS start FROM q JOIN tok t ON t.subkey = q.term) SELECT qid, unit_id, start FROM v JOIN n USING (qid) GROUP BY qid, unit_id, start, want HAVING count(*) = want""",
)
def c25_phrases(spark, sf):
    """The third to sixth word of every item, wherever they stand in this order."""
    four = benchmark_terms(spark, sf).filter("nth BETWEEN 2 AND 5").withColumn("nth", F.col("nth") - 2)
    return corpus_index(spark, sf).phrases(four).select("qid", "unit_id", F.col("at").cast("long").alias("start"))


@query(
    "c26_families",
    f"""WITH {SEQ}, {JAC}, i AS (SELECT a, b, x.text FROM jac JOIN ds x ON x.unit_id = a JOIN ds y ON y.unit_id = b WHERE x.text = y.text), u AS (SELECT DISTINCT unnest([a, b]) AS unit_id, text FROM i)
 SELECT md5(text) AS family, 'identical' AS kind, count(*) AS size FROM u GROUP BY text UNION ALL SELECT a || ':' || b, 'near', 2 FROM jac JOIN ds x ON x.unit_id = a JOIN ds y ON y.unit_id = b WHERE x.text <> y.text AND jac >= 0.45""",
)
def c26(spark, sf):
    s, p = near_copies(spark, sf)
    return audit.families(p, s.select("unit_id", "text"))
