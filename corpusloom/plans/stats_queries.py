"""Statistics on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import stats as st
from corpusloom.plans import model_queries as mq
from corpusloom.plans import tables as tb
from corpusloom.plans.registry import query

B, U, D, T, TT = tb.BASKET, tb.BASKET_UNITS, tb.DOC_TOK, tb.TURNS, tb.TURN_TOK


def basket_full(spark, sf):
    return tb.basket(spark, sf).join(tb.basket_units(spark, sf).withColumnRenamed("status", "ustatus"), "unit_id")


BF = f"{B}, {U}, bf AS (SELECT * FROM tok JOIN unit USING (unit_id))"


@query("a01_dimension_counts", f"WITH {B} SELECT p_partkey, count(unit_id) AS occurrences FROM part LEFT JOIN tok ON subkey = p_partkey GROUP BY 1")
def a01(spark, sf):
    dim = tb.load(spark, sf, "part").select("p_partkey")
    return st.add_counts(dim, tb.load(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"], "occurrences")


@query("a02_key_frequency", f"WITH {D} SELECT key, count(*) AS occurrences, count(DISTINCT subkey) AS subkeys, count(DISTINCT grp) AS groups FROM tok WHERE key IS NOT NULL GROUP BY key")
def a02(spark, sf):
    return st.key_frequency(tb.doc_tokens(spark, sf))


@query("a03_frequencies", f"WITH {D} SELECT 'form' AS what, surface AS item, count(*) AS n FROM tok GROUP BY 2 UNION ALL SELECT 'subkey', subkey, count(*) FROM tok WHERE subkey IS NOT NULL GROUP BY 2")
def a03(spark, sf):
    return st.frequencies(tb.doc_shapes(spark, sf), {"form": "surface", "subkey": "subkey"}, "n")


PROFILE = f"""{D}, g AS (SELECT DISTINCT source AS grp FROM documents), tg AS (SELECT grp, count(*) AS tokens, count(DISTINCT key) AS keys FROM tok GROUP BY grp),
 ug AS (SELECT source AS grp, count(*) AS units FROM documents GROUP BY 1),
 pf AS (SELECT grp, units, tokens, keys, round(tokens / units, 2) AS avg_tokens, round(1000.0 * keys / tokens, 1) AS richness FROM g LEFT JOIN ug USING (grp) LEFT JOIN tg USING (grp))"""


def profile(spark, sf):
    d = tb.load(spark, sf, "documents").select(F.col("source").alias("grp"))
    return st.group_profile(d.distinct(), tb.doc_tokens(spark, sf), d)


@query("a04_group_profile", f"WITH {PROFILE} SELECT * FROM pf")
def a04(spark, sf):
    return profile(spark, sf)


@query("a05_frequency_by_attribute", f"WITH {BF} SELECT key, count(*) FILTER (attr = 'AUTOMOBILE') AS automobile, count(*) FILTER (attr = 'BUILDING') AS building FROM bf GROUP BY key")
def a05(spark, sf):
    p = basket_full(spark, sf).groupBy("key").pivot("attr", ["AUTOMOBILE", "BUILDING"]).agg(F.count(F.lit(1))).fillna(0)
    return p.withColumnsRenamed({"AUTOMOBILE": "automobile", "BUILDING": "building"})


@query("a06_distribution", f"WITH {B} SELECT size, count(*) AS n FROM tok WHERE tag = 'R' AND kind = 'PROMO' GROUP BY size")
def a06(spark, sf):
    return st.frequency(tb.basket(spark, sf).filter("tag = 'R' AND kind = 'PROMO'"), "size")


@query("a07_richness", f"WITH {PROFILE} SELECT grp, richness FROM pf ORDER BY richness DESC, grp LIMIT 15")
def a07(spark, sf):
    return profile(spark, sf).select("grp", "richness").orderBy(F.desc("richness"), "grp").limit(15)


@query("a08_division_ranges", f"WITH {U} SELECT grp, min(day) AS first_day, max(day) AS last_day, min(unit_id) AS first_unit, max(unit_id) AS last_unit FROM unit GROUP BY grp")
def a08(spark, sf):
    return tb.basket_units(spark, sf).groupBy("grp").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min("unit_id").alias("first_unit"), F.max("unit_id").alias("last_unit"))


@query(
    "a09_facets",
    f"""WITH {BF} SELECT 'tag' AS facet, tag AS value, count(*) AS n FROM bf GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM bf GROUP BY 2 UNION ALL SELECT 'prio', prio, count(*) FROM bf WHERE tag = 'R' GROUP BY 2
 UNION ALL SELECT 'attr', attr, count(*) FROM bf GROUP BY 2 UNION ALL SELECT 'size', CAST(size AS VARCHAR), count(*) FROM bf WHERE status = 'O' GROUP BY 2 UNION ALL SELECT 'both', tag || status, count(*) FROM bf GROUP BY 2""",
)
def a09(spark, sf):
    c = F.col
    facets = {"tag": c("tag"), "kind": c("kind"), "prio": F.when(c("tag") == "R", c("prio")), "attr": c("attr"), "size": F.when(c("status") == "O", c("size")), "both": F.concat("tag", "status")}
    return st.facet_counts(basket_full(spark, sf), facets)


END = f"en AS (SELECT doc_id AS pos, source AS grp, CASE WHEN len(ws) = 0 THEN '' ELSE right(ws[-1], 2) END AS ending FROM (SELECT doc_id, source, {tb.words_sql('text')} AS ws FROM documents))"


def endings(spark, sf):
    return tb.load(spark, sf, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("pos"), "text")


@query("a10_ending_shares", f"WITH {END} SELECT ending, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100 / (SELECT count(*) FROM en), 1) AS pct FROM en GROUP BY ending")
def a10(spark, sf):
    return st.ending_atlas(endings(spark, sf), tx.ending(F.col("text"), 2))[0]


@query(
    "a10_ending_dominant",
    f"""WITH {END}, c AS (SELECT grp, ending, count(*) AS n FROM en GROUP BY 1,2), r AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS units, row_number() OVER (PARTITION BY grp ORDER BY n DESC, ending) AS r FROM c)
 SELECT grp, ending AS dominant, CAST(round(n * 100 / units, 0) AS BIGINT) AS pct, CAST(units AS BIGINT) AS units FROM r WHERE r = 1""",
)
def a10b(spark, sf):
    return st.ending_atlas(endings(spark, sf), tx.ending(F.col("text"), 2))[1]


@query("a10_ending_signature", f"WITH {END}, n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) AS r FROM en) SELECT grp, (r-1)//10000 AS part, string_agg(ending, '' ORDER BY pos) AS signature FROM n GROUP BY 1,2")
def a10c(spark, sf):
    return st.ending_signature(endings(spark, sf), tx.ending(F.col("text"), 2))


@query("a11_repeated_texts", "SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) >= 2")
def a11(spark, sf):
    return st.repeated_texts(tb.load(spark, sf, "documents"), "text", ["doc_id"]).select(F.md5("text").alias("h"), "n", "doc_id")


@query("a11_landmarks", "(SELECT 'longest' AS what, doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) UNION ALL (SELECT 'shortest', doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 10)")
def a11b(spark, sf):
    d = tb.load(spark, sf, "documents").select("doc_id", "n_chars")
    top = d.orderBy(F.desc("n_chars"), "doc_id").limit(10).select(F.lit("longest").alias("what"), "*")
    return top.unionByName(d.orderBy("n_chars", "doc_id").limit(10).select(F.lit("shortest").alias("what"), "*"))


@query(
    "a12_global_stats",
    f"""WITH {D} SELECT 'groups' AS name, count(DISTINCT grp) AS n FROM tok UNION ALL SELECT 'units', (SELECT count(*) FROM documents) UNION ALL SELECT 'tokens', count(*) FROM tok
 UNION ALL SELECT 'keys', count(DISTINCT key) FROM tok UNION ALL SELECT 'subkeys', count(DISTINCT subkey) FROM tok""",
)
def a12(spark, sf):
    return st.corpus_totals(tb.doc_tokens(spark, sf), tb.load(spark, sf, "documents"))


@query("a13_dominant_category", f"WITH {B}, c AS (SELECT subkey, tag, count(*) AS n FROM tok GROUP BY 1,2) SELECT subkey, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY subkey ORDER BY n DESC, tag) AS r FROM c) WHERE r = 1")
def a13(spark, sf):
    return st.dominant(tb.basket(spark, sf), "subkey", "tag")


# two sides of seed words; a document's language is the tag of its words
SIDES = [("a", "thention"), ("a", "that"), ("b", "with"), ("b", "from")]
SIDES_SQL = "seeds AS (SELECT * FROM (VALUES " + ", ".join(map(str, SIDES)) + ") t(side, subkey))"
COLL = f"""{D}, {SIDES_SQL}, dm AS (SELECT subkey FROM (SELECT subkey, attr, row_number() OVER (PARTITION BY subkey ORDER BY count(*) DESC, attr) AS r FROM tok WHERE subkey IS NOT NULL GROUP BY 1,2) WHERE r = 1 AND attr NOT IN ('fr','es')),
 us AS (SELECT DISTINCT side, unit_id FROM tok JOIN seeds USING (subkey)),
 coll AS (SELECT side, subkey, count(*) AS n FROM tok JOIN us USING (unit_id) WHERE subkey IN (FROM dm) AND subkey NOT IN (SELECT subkey FROM seeds) GROUP BY 1,2)"""


def coll(spark, sf):
    rows = tb.doc_folds(spark, sf).select(F.col("attr").alias("tag"), "items")
    return st.collocates_in_rows(rows, SIDES, ["fr", "es"])


@query("a14_collocates", f"WITH {COLL} SELECT side, subkey, n FROM coll")
def a14(spark, sf):
    return coll(spark, sf)


@query(
    "a15_usage_map",
    f"""WITH {D}, {SIDES_SQL}, o AS (SELECT t.*, side, lead(surface) OVER (PARTITION BY unit_id ORDER BY tok_no) AS nx FROM tok t LEFT JOIN seeds USING (subkey)), s AS (SELECT * FROM o WHERE side IS NOT NULL)
 SELECT side, 'group' AS facet, grp AS value, count(*) AS n FROM s GROUP BY 1,3 UNION ALL SELECT side, 'language', attr, count(*) FROM s GROUP BY 1,3 UNION ALL SELECT side, 'form', surface, count(*) FROM s GROUP BY 1,3
 UNION ALL SELECT side, 'next_th', 'yes', count(*) FROM s WHERE starts_with(nx, 'th') GROUP BY 1 UNION ALL SELECT side, 'total', 'all', count(*) FROM s GROUP BY 1""",
)
def a15(spark, sf):
    seeds = spark.createDataFrame(SIDES, "side string, subkey string")
    t = tb.doc_tokens_with_next(spark, sf)
    c = F.col
    return st.usage_map(t, seeds, {"group": c("grp"), "language": c("attr"), "form": c("surface")}, {"next_th": F.startswith("next_surface", F.lit("th"))})


@query(
    "a16_contrast",
    f"""WITH {COLL}, x AS (SELECT side, subkey, n FROM coll c WHERE n >= 2 AND NOT EXISTS (FROM coll d WHERE d.subkey = c.subkey AND d.side <> c.side))
 SELECT side, subkey, n FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, subkey) AS r FROM x) WHERE r <= 25""",
)
def a16(spark, sf):
    return st.contrast(coll(spark, sf), "a", "b")


@query(
    "a17_keyness",
    f"""WITH {D}, n AS (SELECT attr AS cls, key, count(*) AS n FROM tok WHERE key IS NOT NULL GROUP BY 1,2), t AS (SELECT *, sum(n) OVER (PARTITION BY cls) AS tot, sum(n) OVER (PARTITION BY key) AS alln, sum(n) OVER () AS total FROM n),
 s AS (SELECT cls, key, n, round((n / tot) / (alln / total), 2) AS score FROM t WHERE n >= 4)
 SELECT cls, key, n, score FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, n DESC, key) AS r FROM s) WHERE r <= 14""",
)
def a17(spark, sf):
    return st.keyness(tb.doc_tokens(spark, sf).filter("key IS NOT NULL").withColumn("cls", F.col("attr")))


@query(
    "a18_distinctive",
    f"""WITH {D}, d AS (SELECT DISTINCT grp AS cls, key, unit_id FROM tok WHERE key IS NOT NULL), n AS (SELECT cls, key, count(*) AS n FROM d GROUP BY 1,2), f AS (SELECT key, count(DISTINCT unit_id) AS df FROM d GROUP BY 1),
 s AS (SELECT cls, n.key, n, round(n / sqrt(df), 6) AS score FROM n JOIN f ON f.key = n.key)
 SELECT cls, key, n, score FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, key) AS r FROM s) WHERE r <= 3""",
)
def a18(spark, sf):
    return st.distinctive(tb.doc_tokens(spark, sf).filter("key IS NOT NULL").withColumn("cls", F.col("grp")))


@query("a19_count_difference", f"WITH {D}, c AS (SELECT key, count(*) FILTER (attr='en') AS n_a, count(*) FILTER (attr='de') AS n_b FROM tok WHERE key IS NOT NULL GROUP BY key) SELECT key, n_a, n_b, n_a - n_b AS diff FROM c WHERE n_a - n_b >= 2")
def a19(spark, sf):
    t = tb.doc_tokens(spark, sf).filter("key IS NOT NULL")
    return st.count_difference(t.filter("attr = 'en'"), t.filter("attr = 'de'"), "key")


@query("a20_timeline", f"WITH {BF} SELECT n_nationkey AS grp, n_regionkey * 100 + n_nationkey AS rank, (SELECT count(*) FROM bf WHERE grp = n_nationkey AND key = 'Brand#9') AS n FROM nation")
def a20(spark, sf):
    g = tb.load(spark, sf, "nation").selectExpr("n_nationkey grp", "n_regionkey * 100 + n_nationkey rank")
    return st.timeline(g, basket_full(spark, sf), "Brand#9")


@query("a20_timeline_ends", f"WITH {BF}, l AS (SELECT grp, n_regionkey * 100 + n_nationkey AS rank, count(*) AS n FROM bf JOIN nation ON n_nationkey = grp WHERE key = 'Brand#9' GROUP BY 1,2) SELECT arg_min(grp, rank) AS first_grp, arg_max(grp, rank) AS last_grp, CAST(sum(n) AS BIGINT) AS total FROM l")
def a20b(spark, sf):
    return st.timeline_ends(a20(spark, sf))


PS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


@query("a21_index_quantiles", f"WITH p AS (SELECT unnest({PS})::DOUBLE AS p), s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS r, count(*) OVER () AS n FROM documents) SELECT p, n_chars AS value FROM p, s WHERE r = floor(p * (n - 1)) + 1")
def a21(spark, sf):
    return st.index_quantiles(tb.load(spark, sf, "documents"), "n_chars", PS)


@query("a22_position_percentile", "SELECT o_orderkey, round((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / (count(*) OVER () - 1), 9) AS pct FROM orders")
def a22(spark, sf):
    o = tb.load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return st.position_percentile(o, "o_totalprice", "o_orderkey", "pct").select("o_orderkey", F.round("pct", 9).alias("pct"))


@query("a23_z_scores", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS z_l_quantity FROM lineitem")
def a23(spark, sf):
    z = st.z_scores(tb.load(spark, sf, "lineitem"), ["l_quantity"])
    return z.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.round("z_l_quantity", 6).alias("z_l_quantity"))


@query("a24_effective_number", f"WITH {BF}, c AS (SELECT key, grp, count(*) AS n FROM bf GROUP BY 1,2), p AS (SELECT key, n / sum(n) OVER (PARTITION BY key) AS p FROM c) SELECT key, round(exp(-sum(p * ln(p))), 6) AS effective FROM p GROUP BY key")
def a24(spark, sf):
    c = basket_full(spark, sf).groupBy("key", "grp").agg(F.count(F.lit(1)).alias("n"))
    return st.effective_number(c, ["key"]).select("key", F.round("effective", 6).alias("effective"))


@query("a25_any_flags", f"WITH {B} SELECT unit_id, bool_or(tag = 'R') AS returned, bool_or(qty > 45) AS large, bool_or(kind = 'PROMO' AND size > 20) AS promo FROM tok GROUP BY unit_id")
def a25(spark, sf):
    return st.any_flags(tb.basket(spark, sf), ["unit_id"], {"returned": F.expr("tag = 'R'"), "large": F.expr("qty > 45"), "promo": F.expr("kind = 'PROMO' AND size > 20")})


@query("a26_document_frequency", f"WITH {D}, d AS (SELECT key, count(DISTINCT unit_id) AS df FROM tok WHERE key IS NOT NULL GROUP BY key) SELECT key, df, df < 5 AS rare, df > 0.15 * (SELECT count(*) FROM documents) AS stop FROM d")
def a26(spark, sf):
    rows = tb.doc_folds(spark, sf).select(F.transform("items", lambda w: F.substring(w, 1, 4)).alias("items"))
    d = st.document_frequency_in_rows(rows)
    total = tb.load(spark, sf, "documents").agg(F.count(F.lit(1)))
    return d.withColumn("t", total.scalar()).select("key", "df", (F.col("df") < 5).alias("rare"), (F.col("df") > 0.15 * F.col("t")).alias("stop"))


@query(
    "a27_rescale_best",
    f"""WITH {U}, b AS (SELECT c_nationkey AS grp, max(o_totalprice) AS best FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND o_totalprice > 0 GROUP BY 1), s AS (SELECT min(best) AS lo, max(best) AS hi FROM b)
 SELECT n_nationkey AS grp, round(coalesce(0.3 + 0.7 * (best - lo) / (hi - lo), 0), 6) AS heat FROM nation LEFT JOIN b ON grp = n_nationkey, s""",
)
def a27(spark, sf):
    o = tb.load(spark, sf, "orders").filter("o_orderstatus = 'P'").join(tb.load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = tb.load(spark, sf, "nation").select(F.col("n_nationkey").alias("grp"))
    return st.rescale_best(o.select(F.col("c_nationkey").alias("grp"), "o_totalprice"), g, "o_totalprice").select("grp", F.round("heat", 6).alias("heat"))


@query("a28_cluster_home", f"WITH {BF}, c AS (SELECT key, attr, count(*) AS n FROM bf GROUP BY 1,2) SELECT key, attr, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, attr) AS r FROM c) WHERE r = 1")
def a28(spark, sf):
    return st.dominant(basket_full(spark, sf), "key", "attr")


@query("a29_dashboard_counts", f"WITH {BF} SELECT prio, attr, count(*) AS n, count(DISTINCT unit_id) AS units FROM bf GROUP BY 1,2")
def a29(spark, sf):
    return basket_full(spark, sf).groupBy("prio", "attr").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit_id").alias("units"))


@query(
    "a30_name_spans",
    f"""WITH {T}, {TT}, {mq.SPANS}, tk AS (SELECT grp, pos, tok_no, surface, key, CASE WHEN regexp_matches(surface, '^[A-Z]') THEN 'PN' ELSE 'N' END AS tag FROM ttok),
 r AS (SELECT tk.*, span_id FROM tk JOIN sp ON sp.grp = tk.grp AND tk.pos BETWEEN first AND last),
 nn AS (SELECT span_id, surface, row_number() OVER (PARTITION BY span_id ORDER BY count(*) DESC, surface) AS r FROM r WHERE tag = 'PN' AND length(surface) > 8 AND surface NOT IN ('The','And') GROUP BY 1,2),
 df AS (SELECT key, count(DISTINCT (grp, pos)) AS df FROM tk WHERE key IS NOT NULL GROUP BY 1),
 tf AS (SELECT span_id, key, surface, count(*) AS n FROM r WHERE key IS NOT NULL GROUP BY 1,2,3),
 bs AS (SELECT span_id, key, sum(n) OVER (PARTITION BY span_id, key) AS c, surface, row_number() OVER (PARTITION BY span_id, key ORDER BY n DESC, surface) AS q FROM tf),
 sc AS (SELECT span_id, surface, row_number() OVER (PARTITION BY span_id ORDER BY round(c * ln((SELECT count(*) FROM turns) / df), 6) DESC, key) AS r FROM bs JOIN df USING (key) WHERE q = 1),
 pl AS (SELECT span_id, surface, min(o) AS o FROM (SELECT span_id, surface, r AS o FROM nn WHERE r <= 2 UNION ALL SELECT span_id, surface, 100 + r FROM sc WHERE r <= 6) GROUP BY 1,2),
 ch AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY o, surface) AS k FROM pl),
 nm AS (SELECT span_id, string_agg(surface, ' · ' ORDER BY o, surface) AS name FROM ch WHERE k <= 2 GROUP BY 1)
 SELECT span_id, coalesce(name, '—') AS name FROM sp LEFT JOIN nm USING (span_id)""",
)
def a30(spark, sf):
    t = tb.turn_tokens(spark, sf)
    t = t.withColumn("tag", F.when(F.col("surface").rlike("^[A-Z]") & (F.length("surface") > 8), "PN").otherwise("N"))
    total = tb.turns(spark, sf).agg(F.count(F.lit(1)))
    return st.name_spans(t, mq.spans(spark, sf), "PN", ["The", "And"], total.scalar())


@query("a31_hierarchy", f"WITH {BF} SELECT attr AS section, key AS topic, count(DISTINCT unit_id) AS units, CAST(grouping(attr, key) AS BIGINT) AS level FROM bf GROUP BY ROLLUP (attr, key)")
def a31(spark, sf):
    return st.hierarchy_totals(basket_full(spark, sf).withColumnsRenamed({"attr": "section", "key": "topic"}), "section", "topic", "unit_id")
