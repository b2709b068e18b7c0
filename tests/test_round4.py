"""Steps that sent more rows than their result needs: counted here in shuffled records."""

from pyspark.sql import functions as F

from corpusloom.operators import graph, pairs, vectors
from corpusloom.operators import stats as st
from corpusloom.plans import stats_queries as sq
from corpusloom.plans import tables as tb


def shuffled(spark, work):
    """Result rows of ``work`` and the bytes its shuffles wrote."""
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = total()
    rows = work().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, total() - before


def test_hops_of_many_sources_move_bits(spark):
    edges = spark.range(2000).select(F.col("id").alias("src"), F.explode(F.array(*[(F.col("id") * 7 + i * 311 + 1) % 2000 for i in range(4)])).alias("dst"))
    sources = spark.range(0, 2000, 15).select(F.col("id").alias("node"))  # 134 of them: more than one row of bits
    rows, size = shuffled(spark, lambda: graph.hop_distances(edges, sources))
    near = {n: set() for n in range(2000)}
    for r in edges.collect():
        near[r.src].add(r.dst)
        near[r.dst].add(r.src)
    want = {}
    for s in range(0, 2000, 15):
        dist, front = {s: 0}, [s]
        while front:
            front = [o for o in {o for n in front for o in near[n]} if o not in dist and not dist.update({o: dist[front[0]] + 1})]
        want |= {(s, n): h for n, h in dist.items()}
    assert {(r.source, r.node): r.hops for r in rows} == want and len(rows) == len(want)
    assert size < 6_000_000


def test_whole_sums_are_those_by_component(spark):
    vecs = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.sin(F.col("id") * i)).alias("vec"))
    members = spark.range(400).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id") % 7).alias("node"), "id")  # one crowded group
    got = {r.node: r.sum for r in vectors.whole_sums(members, vecs, "node", most=16).collect()}
    want = {r.node: r.sum for r in vectors.vector_sums(members.join(vecs, "id"), ["node"]).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for n in got for a, b in zip(got[n], want[n]))


def test_rare_key_sets_are_the_rare_rows(spark):
    rows = [(u, k) for u in range(30) for k in range(12) if (u * k) % 11 < k] + [(1, None), (2, 3), (2, 3)]
    t = spark.createDataFrame(rows, "unit_id long, key long")
    k = t.dropna().distinct()
    want = pairs.key_sets(k, k.groupBy("key").agg(F.count(F.lit(1)).alias("n")), 15).filter("rare").collect()
    got = pairs.rare_key_sets(t, 15).collect()
    each = lambda found: sorted((r.unit_id, r.key, r.rare) for r in found)
    assert want and each(got) == each(want)


def test_null_model_sends_slots_once(spark):
    links = spark.range(4000).select((F.col("id") % 700).alias("src"), ((F.col("id") * 37) % 501).alias("dst")).distinct()
    themes = spark.range(501).select("id", (F.col("id") % 9).alias("theme"))
    rows, size = shuffled(spark, lambda: graph.null_model(links, themes, 4, runs=8, block=64))
    whole = {r.run: r.top for r in graph.null_model(links, themes, 4, runs=8).collect()}
    assert {r.run: r.top for r in rows} == whole and len(whole) == 9
    # the same by a plain sort of every run
    l = links.join(themes.withColumnRenamed("id", "dst"), "dst").orderBy("src", "dst").collect()
    every = spark.createDataFrame([(run, i + 1) for run in range(1, 9) for i in range(len(l))], "run int, slot long")
    hashed = every.select("run", "slot", F.xxhash64(F.lit(7), "run", "slot").alias("h")).orderBy("run", "h", "slot").collect()
    for run in range(1, 9):
        order = [r.slot - 1 for r in hashed if r.run == run]
        spread = {}
        for i, at in enumerate(order):
            spread.setdefault(l[i].src, set()).add(l[at].theme)
        assert whole[run] == sum(len(s) >= 4 for s in spread.values())
    assert size < 1_000_000


def test_forms_are_counted_before_they_are_folded(spark, tmp_path):
    texts = ["Thé the\tTHE 12, the. ...", "the\n\nthé İx Σας", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")}).write.parquet(f"{tmp_path}/documents.parquet")
    labels = {"form": "surface", "subkey": "subkey"}
    each = lambda df: sorted(map(tuple, df.select("what", "item", "n").collect()))
    got = each(sq.a03(spark, str(tmp_path)))
    assert got == each(st.frequencies(tb.doc_tokens(spark, str(tmp_path)), labels))
    assert ("subkey", "the", 6) in got
    plan = tb.doc_shapes(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("Generate") and "regexp_replace" not in plan[plan.index("Generate"):]  # no fold of tokens
