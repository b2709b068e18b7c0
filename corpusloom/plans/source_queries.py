"""Readers, sinks and stream jobs over files that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.scale import scratch_path
from corpusloom.plans import graph_queries as gq
from corpusloom.plans import pair_queries as pq
from corpusloom.plans import tables as tb
from corpusloom.plans import vector_queries as vq
from corpusloom.plans.registry import query
from corpusloom.sources import readers as r
from corpusloom.sources import sinks as s
from corpusloom.streaming import streams as st

FLAT = "trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))"


def flat(c="text"):
    return F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " "))


def conv(spark, sf):
    return tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("grp"), (F.col("turn") + 1).alias("pos"), flat().alias("text"), "role")


@query("s01_read_piped", f"WITH c AS (SELECT conv_id AS grp, turn + 1 AS pos, {FLAT} AS t FROM conversations) SELECT grp, pos, CASE WHEN pos = 1 AND grp NOT IN (1, 9) AND starts_with('pre fix ' || t, 'pre fix') THEN t ELSE 'pre fix ' || t END AS text FROM c")
def s01(spark, sf):
    p = scratch_path(spark, "piped")
    lines = conv(spark, sf).select(F.concat_ws("|", "grp", "pos", F.concat(F.lit("pre fix "), "text")).alias("value"))
    noise = conv(spark, sf).select(F.when(F.col("pos") % 2 == 0, F.concat(F.lit("# note "), "text")).otherwise(F.lit("  ")).alias("value"))
    lines.unionByName(noise).write.text(p)
    return r.read_piped(spark, p, "pre fix", [1, 9])


@query("s02_read_segments", "SELECT CAST(o_custkey AS INTEGER) AS grp, CAST(l_orderkey AS INTEGER) AS pos, l_linenumber AS tok_no, CAST(l_suppkey AS INTEGER) AS seg_no, p_name AS text, l_returnflag AS cls, 'A|K:' || l_partkey AS features, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def s02(spark, sf):
    p = scratch_path(spark, "segments")
    li = tb.load(spark, sf, "lineitem").join(tb.load(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(tb.load(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    li.select(F.concat_ws(":", "o_custkey", "l_orderkey", "l_linenumber", "l_suppkey"), "p_name", "l_returnflag", F.concat(F.lit("A|K:"), "l_partkey")).write.csv(p, sep="\t", quote="")
    d = r.read_segments(spark, p).drop("address")
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))


@query("s03_read_xml", "SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS kind, CAST(c_nationkey AS INTEGER) AS start FROM customer")
def s03(spark, sf):
    p = scratch_path(spark, "xml")
    c = tb.load(spark, sf, "customer").selectExpr("c_custkey as _id", "c_mktsegment as _kind", "c_nationkey as _start")
    c.write.format("xml").option("rootTag", "groups").option("rowTag", "group").save(p)
    return r.read_xml(spark, p, "group", "_id long, _kind string, _start int").selectExpr("_id id", "_kind kind", "_start start")


@query("s04_lines_by_position", "SELECT conv_id AS grp, CAST(turn + 1 AS BIGINT) AS pos, role || ' ' || conv_id AS text FROM conversations")
def s04(spark, sf):
    p = scratch_path(spark, "lines")
    c = conv(spark, sf)
    c.repartitionByRange(4, "grp", "pos").sortWithinPartitions("grp", "pos").select(F.concat_ws(" ", "role", "grp").alias("value")).write.text(p)
    return r.read_lines_by_position(spark, p, c.groupBy("grp").agg(F.count(F.lit(1)).alias("size")))


@query("s05_unit_tree", f"SELECT conv_id % 4 AS grp, conv_id AS pos, count(*) AS n, CAST(sum(length({FLAT})) AS BIGINT) AS chars FROM conversations WHERE {FLAT} <> '' GROUP BY 1, 2")
def s05(spark, sf):
    p = scratch_path(spark, "tree")
    conv(spark, sf).select((F.col("grp") % 4).alias("g"), F.col("grp").alias("p"), "text").write.partitionBy("g", "p").json(p)
    d = r.read_unit_tree(spark, p, "text string", "g=([0-9]+)/", "p=([0-9]+)/")
    return d.groupBy("grp", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s06_read_jsonl", "SELECT CASE WHEN event_id % 10 = 0 THEN 'malformed' WHEN event_id % 10 = 1 THEN 'incomplete' ELSE 'good' END AS state, count(*) AS n FROM events GROUP BY 1")
def s06(spark, sf):
    p = scratch_path(spark, "jsonl")
    e = tb.load(spark, sf, "events")
    good = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{oops "), "event_type")).when(F.col("event_id") % 10 == 1, F.to_json(F.struct("event_type"))).otherwise(good)
    e.select(line.alias("value")).write.text(p)
    return r.read_jsonl(spark, p, "event_id long, event_type string", ["event_id"])[1].select("state", "n")


@query("s07_range_csv", "SELECT CAST(o_custkey AS BIGINT) AS grp, CAST(o_orderkey AS BIGINT) AS first, CAST(o_orderkey + 5 AS BIGINT) AS last, 7 AS n, o_orderpriority AS topic FROM orders WHERE o_orderkey % 9 <> 0")
def s07(spark, sf):
    p = scratch_path(spark, "ranges")
    o = tb.load(spark, sf, "orders")
    ref = F.when(F.col("o_orderkey") % 9 == 0, F.lit("?")).otherwise(F.concat(F.col("o_custkey"), F.lit(":"), F.col("o_orderkey"), F.lit("-"), F.col("o_orderkey") + 5))
    o.select(ref, F.lit(7), "o_orderpriority").write.csv(p)
    return r.read_range_csv(spark, p)


HTML = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br[ ]*/?>', ' ', 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("s08_keyed_texts", f"SELECT trim(url) AS key, md5({HTML}) AS h FROM pages WHERE trim(url) <> '' AND {HTML} <> ''")
def s08(spark, sf):
    return r.keyed_texts(tb.load(spark, sf, "pages"), ["word", "url"], "html").select("key", F.md5("text").alias("h"))


@query("s09_write_vectors", f"WITH {vq.QUANT} SELECT id, round(scale, 9) AS scale, array_to_string(q, ',') AS q FROM qt")
def s09(spark, sf):
    p = scratch_path(spark, "vectors")
    s.write_vectors(vq.unit(spark, sf), p)
    return spark.read.parquet(p).select("id", F.round("scale", 9).alias("scale"), F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


@query("s10_graph_csv", f"WITH {tb.BASKET}, {pq.EDGES} SELECT a AS source, b AS target, weight FROM edges WHERE weight >= 3")
def s10(spark, sf):
    p = scratch_path(spark, "graph")
    e = pq.basket_edges(spark, sf).select(F.col("a").alias("source"), F.col("b").alias("target"), "weight")
    s.write_graph(tb.load(spark, sf, "part").select(F.col("p_brand").alias("id")).distinct(), e, p)
    return spark.read.csv(f"{p}/edges", header=True, schema="source string, target string, weight long")


@query("s11_partitioned_export", "SELECT source, lang AS grp, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2")
def s11(spark, sf):
    p = scratch_path(spark, "export")
    d = tb.load(spark, sf, "documents").select("source", F.col("lang").alias("grp"), "doc_id", "text")
    s.write_by_group(d, p)
    back = spark.read.schema("doc_id long, text string, source string, grp string").json(p)
    return back.groupBy("source", "grp").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))


@query("s12_bundle", f"WITH {tb.BASKET}, {pq.EDGES} SELECT 'keys' AS sheet, count(DISTINCT p_brand) AS rows FROM part UNION ALL SELECT 'edges', count(*) FROM edges WHERE weight >= 3 UNION ALL SELECT 'units', count(*) FROM orders")
def s12(spark, sf):
    sheets = {"keys": tb.load(spark, sf, "part").select("p_brand").distinct(), "edges": pq.basket_edges(spark, sf), "units": tb.load(spark, sf, "orders").select("o_orderkey")}
    return s.write_bundle(sheets, scratch_path(spark, "bundle"))


@query("s13_upsert", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0")
def s13(spark, sf):
    d = tb.load(spark, sf, "documents").select("doc_id", "lang")
    new = d.filter("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("lang"))
    once = s.upsert(d.filter("doc_id % 3 <> 0"), new, ["doc_id"])
    return s.upsert(once, new, ["doc_id"])


@query("s13_replace_source", "SELECT source, CASE WHEN lang = 'en' THEN 'again' ELSE 'first' END AS pass, count(*) AS n FROM (SELECT lang AS source, lang FROM documents) GROUP BY 1, 2")
def s13b(spark, sf):
    p = scratch_path(spark, "rag")
    d = tb.load(spark, sf, "documents").select(F.col("lang").alias("source"), "doc_id")
    s.replace_source(d.withColumn("pass", F.lit("first")), p)
    s.replace_source(d.filter("source = 'en'").withColumn("pass", F.lit("again")), p)
    return spark.read.parquet(p).groupBy("source", "pass").agg(F.count(F.lit(1)).alias("n"))


@query("s14_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s14(spark, sf):
    return s.pending(tb.load(spark, sf, "documents").select("doc_id"), tb.load(spark, sf, "labels"), ["doc_id"])


@query("s15_harvest", "WITH x AS (SELECT l_orderkey AS o, l_suppkey AS hub, l_partkey AS target, l_returnflag AS rel FROM lineitem WHERE l_linestatus = 'F') SELECT hub, target, arg_max(rel, {'o': o, 'r': rel}) AS rel FROM x WHERE target <= (SELECT max(s_suppkey) FROM supplier) GROUP BY 1, 2")
def s15(spark, sf):
    p = scratch_path(spark, "journal")
    li = tb.load(spark, sf, "lineitem")
    part = (F.pmod(F.xxhash64("l_partkey"), F.lit(64))).alias("p")
    hubs = li.groupBy("l_orderkey", "l_linestatus", part, F.col("l_suppkey").alias("hub")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("loc"), F.col("l_returnflag").alias("rel"))).alias("targets"))
    rows = hubs.groupBy(F.col("l_orderkey").alias("run"), F.col("l_linestatus").alias("type"), "p").agg(F.collect_list(F.struct("hub", "targets")).alias("hubs"))
    rows.select("type", "run", F.struct("hubs").alias("result")).write.json(p)
    j = spark.read.schema("type string, run long, result struct<hubs:array<struct<hub:bigint,targets:array<struct<loc:bigint,rel:string>>>>>").json(p)
    known = tb.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return r.harvest(j, known, "F", F.col("run"))[0]


@query("s16_registry", "SELECT 'documents' AS name, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 2) AS avg_chars FROM documents UNION ALL SELECT 'pages', count(*), CAST(sum(length(html)) AS BIGINT), round(avg(length(html)), 2) FROM pages UNION ALL SELECT 'labels', count(*), NULL, NULL FROM labels")
def s16(spark, sf):
    return s.registry({"documents": (tb.load(spark, sf, "documents"), "text"), "pages": (tb.load(spark, sf, "pages"), "html"), "labels": (tb.load(spark, sf, "labels"), None)})


@query("s17_attach_layer", f"SELECT conv_id AS grp, turn + 1 AS pos, role, md5({FLAT}) AS h FROM conversations")
def s17(spark, sf):
    p = scratch_path(spark, "layer")
    c = conv(spark, sf)
    c.select(F.concat_ws("|", "grp", "pos", "text").alias("value")).write.text(p)
    out = r.attach_layer(c.select("grp", "pos", "role"), r.read_piped(spark, p), ["grp", "pos"], "text", "layer")
    return out.select("grp", "pos", "role", F.md5("layer").alias("h"))


@query("s18_archive", f"WITH {gq.LINKS} SELECT id AS hub, 0::BIGINT AS part, '{{\"hub\":' || id || ',\"verdicts\":[' || (SELECT string_agg('{{\"target\":' || dst || ',\"rel\":\"' || rel || '\",\"review\":\"' || coalesce(review, 'unreviewed') || '\"}}', ',' ORDER BY dst) FROM links WHERE src = id) || ']}}' AS line FROM uv")
def s18(spark, sf):
    l = gq.links(spark, sf)
    v = l.select(F.col("src").alias("hub"), F.col("dst").alias("target"), "rel")
    rev = l.filter("review IS NOT NULL").select(F.col("src").alias("hub"), F.col("dst").alias("target"), "review")
    return s.archive(vq.unit(spark, sf).select(F.col("id").alias("hub")), v, rev)


# --- streams ------------------------------------------------------------------------
@query("x01_request_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) > 1 AS limited FROM events")
def x01(spark, sf):
    e = tb.load(spark, sf, "events").select("event_id", F.col("user_id").alias("caller"), "ts")
    return st.request_rate(e, 3600, 1).select("event_id", "recent", "limited")


def deliveries(spark, df, folder, arrival, stream, out):
    """Parts of ``df`` in order of ``arrival``, each written to the folder that
    ``stream`` reads and taken to the table ``out`` before the next comes."""
    checkpoint = scratch_path(spark, "ck")
    for k in range(DELIVERIES):
        df.filter(F.col(arrival) == k).drop(arrival).write.mode("append").parquet(folder)
        st.run_to_table(stream(spark.readStream.schema(df.drop(arrival).schema).parquet(folder)), out, checkpoint)
    return spark.read.parquet(out)


DELIVERIES = 4
ARRIVALS = "b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS w FROM events), a AS (SELECT event_id, user_id, epoch_us(ts) AS us, 3 * (epoch_us(ts) - lo) // w + CAST(event_id % 20 = 0 AS INTEGER) AS arr FROM events CROSS JOIN b)"


@query("x01_request_stream", f"WITH {ARRIVALS} SELECT r.user_id AS caller, r.us, count(*) AS recent, count(*) > 1 AS limited FROM a r JOIN a s ON s.user_id = r.user_id AND s.us <= r.us AND s.us > r.us - 3600000000 AND s.arr <= r.arr GROUP BY r.event_id, r.user_id, r.us")
def x01_stream(spark, sf):
    """Thirds of the time span arrive one after another; every twentieth request is a third late."""
    e = tb.load(spark, sf, "events").select("event_id", F.col("user_id").alias("caller"), F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    lo, hi = e.agg(F.min(us), F.max(us)).first()
    lo, width = lo or 0, (hi or 0) - (lo or 0) + 1
    third = F.expr(f"3 * (unix_micros(ts) - {lo}L) div {width}L")
    late = f"{width // 3_000_000 + 60} seconds"
    e = e.withColumn("arrival", third + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0)).drop("event_id")
    src, out = scratch_path(spark, "requests"), scratch_path(spark, "rates")
    rows = deliveries(spark, e, src, "arrival", lambda s: st.request_rate_stream(s, 3600, 1, late), out)
    return rows.select("caller", us.alias("us"), "recent", "limited")


def graded(spark, sf):
    g = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return tb.load(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), g.cast("int").alias("grade"))


# each grade moves the schedule that the ones before it left, so the twin walks the events of all keys side by side
CARDS = """WITH RECURSIVE ev AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS ms, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS g FROM events),
w AS (SELECT DISTINCT key, 0::BIGINT AS n, 2.3::DOUBLE AS ease, 0::DOUBLE AS interval, 0::BIGINT AS lapses, 0::DOUBLE AS due FROM ev
 UNION ALL SELECT key, n, greatest(1.3, ease + CASE g WHEN 0 THEN -0.2 WHEN 1 THEN -0.15 WHEN 3 THEN 0.1 ELSE 0 END)::DOUBLE, i, lapses + CAST(g = 0 AS INTEGER), ms + CASE WHEN g = 0 THEN 60000 ELSE i * 86400000 END
 FROM (SELECT w.key, ev.n, w.ease, w.lapses, ev.g, ev.ms, CASE WHEN g = 0 THEN 0 WHEN interval = 0 THEN CASE WHEN g = 3 THEN 3 ELSE 1 END
   ELSE greatest(1, floor(round(interval * (CASE g WHEN 1 THEN 1.2 WHEN 3 THEN round(w.ease, 9) * 1.3 ELSE round(w.ease, 9) END)::DOUBLE, 6) + 0.5)) END::DOUBLE AS i FROM w JOIN ev ON ev.key = w.key AND ev.n = w.n + 1))
SELECT key, round(ease, 6) AS ease, interval, lapses, n AS reps, due FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1"""


@query("x02_repetition_state", CARDS)
def x02(spark, sf):
    return st.repetition_state(graded(spark, sf)).withColumn("ease", F.round("ease", 6))


@query("x02_repetition_stream", CARDS)
def x02_stream(spark, sf):
    """Quarters of the grades arrive one after another."""
    e = graded(spark, sf)
    top = e.agg(F.max("seq")).first()[0] or 0
    e = e.withColumn("arrival", F.floor(F.col("seq") * DELIVERIES / (top + 1)))
    rows = deliveries(spark, e, scratch_path(spark, "grades"), "arrival", st.repetition_stream, scratch_path(spark, "cards"))
    return st.latest_cards(rows).withColumn("ease", F.round("ease", 6))


@query("x03_incremental_sink", "SELECT event_id, upper(event_type) AS kind FROM events")
def x03(spark, sf):
    src, out, ck = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    e = tb.load(spark, sf, "events").select("event_id", "event_type")
    enrich = lambda df: df.select("event_id", F.upper("event_type").alias("kind"))
    schema = "event_id long, event_type string"
    for part in (e.filter("event_id % 2 = 0"), e):  # the second delivery repeats half of the rows
        part.write.mode("append").parquet(src)
        st.incremental_sink(spark.readStream.schema(schema).parquet(src), enrich, out, ["event_id"], ck).awaitTermination()
    return spark.read.parquet(out).select("event_id", "kind")


