"""Scalar text functions and text table operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.scale import spread
from corpusloom.operators import textops
from corpusloom.plans import tables as tb
from corpusloom.plans.registry import query

SP = tb.SP


def docs(spark, sf):
    return spread(tb.load(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def adocs(spark, sf):
    return docs(spark, sf).select("doc_id", tb.arabic(F.col("text")).alias("text"))


ADOC = f"adoc AS (SELECT doc_id, {tb.arabic_sql('text')} AS text FROM documents)"


@query("t01_normalise", "SELECT doc_id, md5(t) AS h, length(t) AS n FROM (SELECT doc_id, nfc_normalize(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM documents)")
def t01(spark, sf):
    d = tx.normalise_columns(docs(spark, sf), ["text"])
    return d.select("doc_id", F.md5("text").alias("h"), F.length("text").cast("long").alias("n"))


@query("t02_strip_marks", f"WITH {ADOC} SELECT doc_id, md5(regexp_replace(text, '{tx.MARKS}', '', 'g')) AS h FROM adoc")
def t02(spark, sf):
    return adocs(spark, sf).select("doc_id", F.md5(tx.strip_marks(F.col("text"))).alias("h"))


@query(
    "t03_fold_presets",
    f"WITH {ADOC} " + " UNION ALL ".join(
        f"SELECT doc_id, '{p}' AS preset, md5({tb.fold_sql('text', p)}) AS h FROM adoc" for p in ("search", "forms", "lexicon", "quote")
    ),
)
def t03(spark, sf):
    d = adocs(spark, sf)
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("preset"), F.md5(tx.fold(F.col("text"), p)).alias("h")) for p in ("search", "forms", "lexicon", "quote")]))
    return d.select("doc_id", pairs.alias("x")).select("doc_id", "x.preset", "x.h")


@query(
    "t04_strip_article",
    f"""WITH w AS (SELECT DISTINCT unnest({tb.words_sql(tb.arabic_sql("'al' || text"))}) AS w FROM documents),
 a AS (SELECT w, regexp_replace(w, '^[وفبكل]?ال', '') AS b FROM (SELECT 'ال' || w AS w FROM w UNION ALL SELECT w FROM w))
 SELECT w, CASE WHEN length(b) >= 2 THEN b ELSE w END AS bare, count(*) AS n FROM a GROUP BY ALL""",
)
def t04(spark, sf):
    w = docs(spark, sf).select(F.explode(tx.words(tb.arabic(F.concat(F.lit("al"), "text")))).alias("w")).distinct()
    both = w.select(F.explode(F.array(F.concat(F.lit("ال"), "w"), "w")).alias("w"))
    return both.select("w", tx.strip_article(F.col("w")).alias("bare")).groupBy("w", "bare").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t05_ascii_digits",
    f"WITH {ADOC} SELECT doc_id, length(regexp_replace(translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[^0-9]', '', 'g')) AS digits FROM adoc",
)
def t05(spark, sf):
    return adocs(spark, sf).select("doc_id", F.length(F.regexp_replace(tx.ascii_digits(F.col("text")), "[^0-9]", "")).cast("long").alias("digits"))


@query(
    "t06_addresses",
    """WITH a AS (SELECT o_custkey || ':' || l_orderkey || ':' || l_linenumber AS addr FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
 SELECT addr, CAST(split_part(addr, ':', 1) AS INTEGER) AS g, CAST(split_part(addr, ':', 2) AS INTEGER) AS u,
 CAST(split_part(addr, ':', 3) AS INTEGER) AS t, count(*) AS n FROM a GROUP BY ALL""",
)
def t06(spark, sf):
    li, o = tb.load(spark, sf, "lineitem"), tb.load(spark, sf, "orders")
    a = li.join(o, li.l_orderkey == o.o_orderkey).select(tx.address(F.col("o_custkey"), F.col("l_orderkey"), F.col("l_linenumber")).alias("addr"))
    n = a.groupBy("addr").agg(F.count(F.lit(1)).alias("n"))
    parts = {k: tx.address_part(F.col("addr"), i) for i, k in enumerate(["g", "u", "t"])}
    return n.withColumns(parts)


RANGES = "SELECT p_partkey AS id, p_size || ':' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || (p_size + p_partkey % 7) END AS ref FROM part"


@query("t07_expand_ranges", f"WITH r AS ({RANGES}) SELECT id, ref, unnest(generate_series(CAST(regexp_extract(ref, ':([0-9]+)', 1) AS INTEGER), CAST(regexp_extract(ref, '([0-9]+)$', 1) AS INTEGER)))::INTEGER AS pos FROM r")
def t07(spark, sf):
    p = tb.load(spark, sf, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), (F.col("p_size") + F.col("p_partkey") % 7).cast("string")))
    size = F.col("p_size").cast("string")
    r = p.select(F.col("p_partkey").alias("id"), F.concat(size, F.lit(":"), size, tail).alias("ref"))
    return r.select("id", "ref", F.explode(tx.range_units(F.col("ref"))).alias("pos"))


def marked(c):
    return F.concat(F.lit("[[note "), c, F.lit("]] x | [p "), F.substring(c, 1, 5), F.lit("] ﴿"), c, F.lit("﴾"))


@query(
    "t08_clean_quoted",
    f"""WITH m AS (SELECT doc_id, '[[note ' || text || ']] x | [p ' || substr(text,1,5) || '] ﴿' || text || '﴾' AS t FROM documents)
 SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\[\\[[^\\]]*\\]\\]', ' ', 'g'),
 '\\[[^\\]]*\\]', ' ', 'g'), '\\|', ' ', 'g'), '[﴿﴾]', '', 'g'), '{SP}', ' ', 'g'))) AS h FROM m""",
)
def t08(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.clean_quoted(marked(F.col("text")))).alias("h"))


@query(
    "t09_endings",
    f"""SELECT doc_id, CASE WHEN len(ws) = 0 THEN '' ELSE right(ws[-1], 1) END AS e1, CASE WHEN len(ws) = 0 THEN '' ELSE right(ws[-1], 2) END AS e2
 FROM (SELECT doc_id, {tb.words_sql('text')} AS ws FROM documents)""",
)
def t09(spark, sf):
    return docs(spark, sf).select("doc_id", tx.ending(F.col("text")).alias("e1"), tx.ending(F.col("text"), 2).alias("e2"))


@query("t10_counts", f"SELECT doc_id, CAST(len({tb.words_sql('text')}) AS INTEGER) AS n_words, CAST(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS INTEGER) AS n_letters FROM documents")
def t10(spark, sf):
    return docs(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("n_words"), tx.letter_count(F.col("text"), "[a-zA-Z]").alias("n_letters"))


@query(
    "t11_letters",
    """WITH c AS (SELECT doc_id, unnest(cs) AS letter, generate_subscripts(cs,1) AS pos FROM (SELECT doc_id, string_split(text,'') AS cs FROM documents))
 SELECT letter, CAST(count(*) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM c WHERE regexp_matches(letter,'^[a-zA-Z]$') GROUP BY letter""",
)
def t11(spark, sf):
    ls = tx.letters_table(docs(spark, sf), "text", "[a-zA-Z]")
    return ls.groupBy("letter").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


@query("t12_excerpt", "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text,1,60) || '…' ELSE text END AS head FROM documents")
def t12(spark, sf):
    return docs(spark, sf).select("doc_id", tx.excerpt(F.col("text"), 60).alias("head"))


@query(
    "t13_chunks",
    f"""WITH RECURSIVE d AS (SELECT doc_id, text, len(string_split_regex(text, '{SP}')) AS nw FROM documents),
 s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss,1) AS i FROM (SELECT doc_id,
  string_split(regexp_replace(text, '([.؟!:]){SP}', '\\1\x01', 'g'), '\x01') AS ss FROM d WHERE nw > 400)),
 sw AS (SELECT doc_id, s, i, len(string_split_regex(s, '{SP}')) AS n FROM s),
 walk AS (SELECT doc_id, i, 1 AS part, n AS acc FROM sw WHERE i = 1
  UNION ALL SELECT b.doc_id, b.i, CASE WHEN a.acc + b.n > 330 THEN a.part + 1 ELSE a.part END, CASE WHEN a.acc + b.n > 330 THEN b.n ELSE a.acc + b.n END
  FROM walk a JOIN sw b ON b.doc_id = a.doc_id AND b.i = a.i + 1),
 p AS (SELECT w.doc_id, w.part, string_agg(sw.s, ' ' ORDER BY w.i) AS text FROM walk w JOIN sw ON sw.doc_id = w.doc_id AND sw.i = w.i GROUP BY 1,2),
 q AS (SELECT doc_id, part, max(part) OVER (PARTITION BY doc_id) AS parts, text FROM p)
 SELECT CASE WHEN parts = 1 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || ' — ' || part || '/' || parts END AS ref, part, parts, md5(text) AS h FROM q
 UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 1, md5(text) FROM d WHERE nw <= 400""",
)
def t13(spark, sf):
    d = docs(spark, sf).withColumnRenamed("doc_id", "ref")
    return tx.chunk_refs(d, "ref", "text").select("ref", "part", "parts", F.md5("text").alias("h"))


STARTS, TAILS, PAT = ["The ", "And ", "De ", "Der ", "El "], ["the ", "of ", "que", "und "], "^(An|In|Le)[a-z]* "


@query(
    "t14_cue_flags",
    f"""SELECT doc_id, {' OR '.join(f"starts_with(text,'{s}')" for s in STARTS)} AS opens,
 {' OR '.join(f"contains(right(text,60),'{s}')" for s in TAILS)} AS closes, regexp_matches(text, '{PAT}') AS verbal FROM documents""",
)
def t14(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", tx.starts_with_any(t, STARTS).alias("opens"), tx.tail_has_any(t, TAILS).alias("closes"), t.rlike(PAT).alias("verbal"))


# class and feature string composed from line columns, every rule of the decoder is met
FEAT = """SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'V' ELSE 'P' END AS cls,
 l_partkey % 2 AS p2, l_partkey % 3 AS p3, l_partkey % 5 AS p5, l_suppkey % 4 AS s4, l_suppkey % 3 AS s3, l_linenumber % 4 AS n4, l_shipdate AS ts FROM lineitem"""
_F = [
    ("p5 = 0", "PREF"), ("p5 = 1", "SUFF"), ("s4 = 0", "PERF"), ("s4 = 1", "IMPV"), ("n4 = 1", "PASS"), ("n4 = 2", "ACC"), ("n4 = 3", "GEN"),
    ("s3 = 0", "INDEF"), ("p3 = 1", "ACT_PCPL"), ("s4 = 3", "NV"), ("p3 = 2", "3MS"), ("p2 = 1", "P"), ("s3 = 2", "F"), ("n4 = 0", "NEG"),
]


@query(
    "t15_decode_features",
    f"""WITH f AS ({FEAT}), g AS (SELECT *, s4 = 3 AS nv, n4 = 2 AS acc FROM f)
 SELECT a, b, c, d, ts, cls,
 CASE WHEN p5 = 0 THEN 'prefix' WHEN p5 = 1 THEN 'suffix' ELSE 'stem' END AS role,
 CASE WHEN nv THEN 'NV' WHEN n4 = 0 THEN 'NEG' WHEN acc AND cls = 'P' THEN 'ACC' WHEN cls = 'P' THEN CASE WHEN s4 = 1 THEN 'IMPV_LAM' ELSE 'P' END ELSE cls END AS pos,
 'R' || (c % 11) AS root, CASE WHEN p2 = 0 THEN 'L' || c END AS lemma, CASE WHEN cls = 'V' THEN CAST(d % 10 AS INTEGER) END AS verb_form,
 CASE WHEN cls = 'V' OR nv THEN CASE s4 WHEN 0 THEN 'PERF' WHEN 1 THEN 'IMPV' END END AS aspect,
 CASE WHEN p3 = 0 THEN 'JUS' END AS mood, CASE WHEN cls = 'V' THEN CASE WHEN n4 = 1 THEN 'PASS' ELSE 'ACT' END END AS voice,
 CASE WHEN cls <> 'P' THEN CASE n4 WHEN 2 THEN 'ACC' WHEN 3 THEN 'GEN' END END AS case_mark, CASE WHEN s3 = 0 THEN 'INDEF' END AS state,
 CAST(CASE WHEN p3 = 2 THEN 3 END AS INTEGER) AS person, CASE WHEN s3 = 2 THEN 'F' WHEN p3 = 2 THEN 'M' END AS gender,
 CASE WHEN p2 = 1 AND cls <> 'P' THEN 'P' WHEN p3 = 2 THEN 'S' END AS number,
 CASE WHEN p3 = 1 THEN 'ACT_PCPL' END AS derivation, CASE WHEN p2 = 1 THEN 'FAM' || (d % 3) END AS family FROM g""",
)
def t15(spark, sf):
    c = F.col
    base = tb.load(spark, sf, "lineitem").selectExpr(
        "l_orderkey a", "l_linenumber b", "l_partkey c", "l_suppkey d", "l_shipdate ts",
        "case l_returnflag when 'A' then 'N' when 'N' then 'V' else 'P' end cls",
        "l_partkey % 2 p2", "l_partkey % 3 p3", "l_partkey % 5 p5", "l_suppkey % 4 s4", "l_suppkey % 3 s3", "l_linenumber % 4 n4",
    )
    tags = [F.when(F.expr(cond), F.lit(tag)) for cond, tag in _F]
    feats = F.concat_ws(
        "|", *tags, F.concat(F.lit("ROOT:R"), c("c") % 11), F.when(F.expr("p2 = 0"), F.concat(F.lit("LEM:L"), c("c"))),
        F.when(c("cls") == "V", F.concat(F.lit("VF:"), c("d") % 10)), F.when(c("p3") == 0, F.lit("MOOD:JUS")),
        F.when(c("p2") == 1, F.concat(F.lit("FAM:FAM"), c("d") % 3)),
    )
    return tx.decode_features(base.withColumn("feats", feats), "cls", "feats").drop("feats", "p2", "p3", "p5", "s4", "s3", "n4")


@query(
    "t16_spelling_variants",
    f"""WITH k AS (SELECT DISTINCT unnest({tb.words_sql(tb.arabic_sql('text'))}) AS key FROM benchmark),
 f AS (SELECT key, translate(key,'أإآ','ااا') AS fo FROM k),
 c AS (SELECT key, [key, fo, CASE WHEN right(key,1) IN ('و','ي') THEN key[:-2] || 'ا' END, CASE WHEN right(key,1) IN ('و','ي') THEN key[:-2] || 'ى' END,
  CASE WHEN right(key,1) = 'ء' THEN key[:-2] || 'أ' END, CASE WHEN right(fo,1) IN ('و','ي') THEN fo[:-2] || 'ا' END,
  CASE WHEN right(fo,1) IN ('و','ي') THEN fo[:-2] || 'ى' END, CASE WHEN right(fo,1) = 'ء' THEN fo[:-2] || 'أ' END,
  CASE WHEN length(key) = 3 AND substr(key,2,1) = substr(key,3,1) THEN substr(key,1,2) END] AS cs FROM f),
 e AS (SELECT key, unnest(cs) AS cand, generate_subscripts(cs,1) AS i FROM c),
 m AS (SELECT key, cand, min(i) AS i FROM e WHERE cand IS NOT NULL AND cand <> '' GROUP BY 1,2)
 SELECT key, cand, CAST(row_number() OVER (PARTITION BY key ORDER BY i) AS INTEGER) AS prio FROM m""",
)
def t16(spark, sf):
    k = tb.load(spark, sf, "benchmark").select(F.explode(tx.words(tb.arabic(F.col("text")))).alias("key")).distinct()
    return k.select("key", F.posexplode(tx.spelling_variants(F.col("key"))).alias("p", "cand")).select("key", "cand", (F.col("p") + 1).alias("prio"))


def forms(spark, sf):
    return tb.load(spark, sf, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("w")).select(tx.fold(tb.arabic(F.col("w"))).alias("form")).distinct()


def keys(spark, sf):
    toks = tb.turn_tokens(spark, sf).select(tx.fold(tb.arabic(F.col("surface"))).alias("key"))
    return toks.groupBy("key").agg(F.count(F.lit(1)).alias("freq"))


@query("t17_fuzzy_pairs")
def t17(spark, sf):
    return textops.fuzzy_pairs(forms(spark, sf), keys(spark, sf), 1.0)


TRIG, REJ = "the|que|der", "^(And|In) "


@query(
    "t18_contrast_sentences",
    f"""WITH s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss,1) AS i FROM (SELECT doc_id, regexp_extract_all(
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\[\\[[^\\]]*\\]\\]', ' ', 'g'),
 '\\[[^\\]]*\\]', ' ', 'g'), '\\|', ' ', 'g'), '[﴿﴾]', '', 'g'), '{SP}', ' ', 'g')), '[^.؛]*[.؛]|[^.؛]+$') AS ss FROM documents)),
 t AS (SELECT doc_id, trim(s) AS s, min(i) AS i FROM s WHERE trim(s) <> '' GROUP BY 1,2),
 k AS (SELECT * FROM t WHERE regexp_matches(s,'{TRIG}') AND length(s) BETWEEN 18 AND 420 AND NOT regexp_matches(s,'{REJ}') AND NOT regexp_matches(s,'[\\[\\]|]'))
 SELECT doc_id, s AS sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM k) WHERE r <= 3""",
)
def t18(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(tx.contrast_sentences(F.col("text"), TRIG, REJ)).alias("sentence"))


@query(
    "t19_quoted_spans",
    """WITH q AS (SELECT page_id, [('{([^}]{6,300})}'), ('"([^"]{6,200})"'), ('\\(([^)]{6,200})\\)')] AS ps, html FROM pages),
 x AS (SELECT page_id, unnest(regexp_extract_all(html, '\\{([^}]{6,300})\\}', 1)) AS span FROM pages
 UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '"([^"]{6,200})"', 1)) FROM pages
 UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '\\(([^)]{6,200})\\)', 1)) FROM pages
 UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '﴿([^﴾]{6,300})﴾', 1)) FROM pages
 UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '@QB@([^@]{6,300})@QE@', 1)) FROM pages)
 SELECT page_id, span, count(*) AS n FROM x GROUP BY ALL""",
)
def t19(spark, sf):
    p = tb.load(spark, sf, "pages").select("page_id", F.explode(tx.quoted_spans(F.col("html"))).alias("span"))
    return p.groupBy("page_id", "span").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t20_clauses",
    f"""WITH w AS (SELECT grp, pos, unnest(ws) AS t, generate_subscripts(ws,1) AS i FROM (SELECT conv_id AS grp, turn + 1 AS pos, {tb.words_sql('text')} AS ws FROM conversations)),
 f AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(t,'[.,?!]',''), '[a-zA-Zäêèéüöçñíó]') THEN 1 ELSE 0 END AS isw, regexp_matches(t,'[.,?!]') AS mk FROM w),
 g AS (SELECT *, CAST(sum(isw) OVER (PARTITION BY grp,pos ORDER BY i) AS INTEGER) AS wn, CAST(sum(isw) OVER (PARTITION BY grp,pos) AS INTEGER) AS tot FROM f),
 h AS (SELECT DISTINCT grp, pos, tot, CASE WHEN mk THEN wn END AS e FROM g),
 e AS (SELECT grp, pos, tot, e FROM h WHERE e >= 1 UNION SELECT grp, pos, tot, tot FROM h WHERE tot >= 1),
 r AS (SELECT grp, pos, coalesce(lag(e) OVER (PARTITION BY grp,pos ORDER BY e),0) + 1 AS first, e AS last FROM e)
 SELECT grp, pos, first, last FROM r""",
)
def t20(spark, sf):
    t = tb.turns(spark, sf)
    letter = "[a-zA-Zäêèéüöçñíó]"
    n = F.size(F.filter(tx.words(F.col("text")), lambda w: F.regexp_replace(w, "[.,?!]", "").rlike(letter)))
    c = t.select("grp", "pos", F.explode(textops.clause_ranges(F.col("text"), n, letter, "[.,?!]")).alias("c"))
    return c.select("grp", "pos", "c.first", "c.last")


@query("t21_reconcile_tokens")
def t21(spark, sf):
    t = tb.turns(spark, sf).withColumn("ws", tx.words(F.lower("text")))
    fused = F.regexp_replace(F.regexp_replace(F.lower("text"), "\\bde la\\b", "de_la"), "\\b(le|un) ", "$1_")
    t = t.withColumn("target", F.size(tx.words(fused)))
    out = textops.reconcile_tokens(t, "ws", "target", ["le", "un"], [("de", "la")], [])
    return out.select("grp", "pos", "target", F.size("ws").alias("n_before"), F.col("aligned").isNull().alias("misaligned"))


@query(
    "t22_all_words_match",
    f"""WITH q AS (SELECT DISTINCT n_nationkey AS qid, lower(n_name) AS q FROM nation),
 h AS (SELECT s_suppkey, lower(s_name || ' ' || n_name || ' ' || r_name) AS hay, s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
 SELECT s_suppkey, len(list_filter({tb.words_sql('q')}, lambda w: NOT contains(hay, w))) = 0 AS hit, len(list_filter(string_split(substr(q,1,2) || ' ' || r, ' '), lambda w: NOT contains(hay, w))) = 0 AS hit2
 FROM h JOIN q ON qid = s_nationkey, LATERAL (SELECT CAST(s_suppkey % 10 AS VARCHAR) AS r)""",
)
def t22(spark, sf):
    n = tb.load(spark, sf, "nation").join(tb.load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = tb.load(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    hay = F.lower(F.concat_ws(" ", "s_name", "n_name", "r_name"))
    q = F.lower("n_name")
    q2 = F.concat_ws(" ", F.substring(q, 1, 2), (F.col("s_suppkey") % 10).cast("string"))
    return s.select("s_suppkey", tx.all_words_in(q, hay).alias("hit"), tx.all_words_in(q2, hay).alias("hit2"))


@query(
    "t23_title_score",
    f"""WITH h AS (SELECT conv_id, turn, lower(text) AS title, list_filter(string_split('the of que und ' || lower(text), ' '), lambda w: length(w) >= 2 AND w NOT IN ('the','of')) AS toks FROM conversations),
 s AS (SELECT conv_id, turn, len(toks) AS n, len(list_filter(toks, lambda w: contains(title, w))) AS hits FROM h)
 SELECT conv_id, turn, CAST(CASE WHEN hits > 0 AND hits >= least(2, n) THEN hits END AS INTEGER) AS score FROM s""",
)
def t23(spark, sf):
    t = tb.load(spark, sf, "conversations")
    q = F.regexp_replace(F.concat(F.lit("the of que und "), F.lower("text")), "[\\t\\r\\n]", "\x01")
    return t.select("conv_id", "turn", tx.title_score(F.regexp_replace(F.lower("text"), "[\\t\\r\\n]", "\x01"), q, ["the", "of"]).alias("score"))


@query(
    "t24_resolve_lemmas",
    f"""WITH l AS (SELECT min(id) AS lemma_id, lemma FROM (SELECT p_partkey AS id, p_name AS lemma FROM part) GROUP BY lemma
   UNION ALL SELECT 100000000 + p_partkey, upper(p_name) FROM part WHERE p_partkey < 5),
 k AS (SELECT lemma_id, lemma, {tb.fold_sql('lemma')} AS skel FROM l),
 n AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT p_brand FROM part),
 c AS (SELECT name, count(DISTINCT lemma_id) AS n, min(lemma_id) AS any_id, min(CASE WHEN lemma = name THEN lemma_id END) AS ex FROM n LEFT JOIN k ON k.skel = {tb.fold_sql('name')} GROUP BY name)
 SELECT name, CASE WHEN n = 1 THEN any_id ELSE ex END AS lemma_id, CASE WHEN n = 1 THEN 'skeleton' WHEN ex IS NOT NULL THEN 'exact' WHEN n = 0 THEN 'unknown' ELSE 'ambiguous' END AS status FROM c""",
)
def t24(spark, sf):
    p = tb.load(spark, sf, "part")
    lem = p.groupBy(F.col("p_name").alias("lemma")).agg(F.min("p_partkey").alias("lemma_id"))
    lem = lem.unionByName(p.filter("p_partkey < 5").select((F.col("p_partkey") + 100000000).alias("lemma_id"), F.upper("p_name").alias("lemma")))
    names = p.select(F.explode(F.array(F.upper("p_name"), "p_name", "p_brand")).alias("name")).distinct()
    return textops.resolve_lemmas(names, lem, "latin")
