"""Inputs deeper than any fixed number of rounds: nothing may be cut off."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import graph, model, textops, vectors


def test_tree_of_any_height(spark):
    rows = [(i, i - 1 if i else None) for i in range(200)] + [(1000 + i, 1000 + i // 2 if i > 1 else None) for i in range(1, 60)]
    top = {r.id: (r.top, r.hops) for r in model.climb_tree(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert all(top[i] == (0, i) for i in range(200))
    assert all(top[1000 + i] == (1001, i.bit_length() - 1) for i in range(1, 60))


def test_hops_and_roots_along_a_long_chain(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    got = {r.node: r.hops for r in graph.hop_distances(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: i for i in range(n + 1)}
    vecs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n + 1)], "id long, vec array<double>")
    roots = {r.node: r.root for r in graph.upstream_roots(edges, vecs).collect()}
    assert roots == {i: 0 for i in range(1, n + 1)}
    comp = graph.components(edges).agg(F.min("component").alias("a"), F.max("component").alias("b")).first()
    assert (comp.a, comp.b) == (0, 0)


def test_far_forms_get_their_best_key(spark):
    forms = spark.createDataFrame([("zzzzzzzzqqqq",), ("abc",)], "form string")
    keys = spark.createDataFrame([("abd", 3), ("xyxyxyxy", 1), ("zzkk", 2)], "key string, freq long")
    best = {r.form: r.key for r in textops.nearest_keys(forms, keys).filter("rank = 1").collect()}
    assert best == {"abc": "abd", "zzzzzzzzqqqq": "zzkk"}


def test_conflict_chain_is_settled_in_order(spark):
    n = 60
    items = spark.createDataFrame([(0, i, float(n - i)) for i in range(n)], "hub long, id long, w double")
    chain = spark.createDataFrame([(0, i, i + 1) for i in range(n - 1)], "hub long, a long, b long")
    kept = sorted(r.id for r in vectors.greedy_independent(items, chain).collect())
    assert kept == list(range(0, n, 2))


def test_near_duplicates_within_hubs_by_blocks(spark):
    rng = random.Random(1)
    vecs = []
    for i in range(60):
        v = [rng.gauss(0, 1) for _ in range(3)]
        size = sum(x * x for x in v) ** 0.5
        vecs.append((i, [x / size for x in v]))
    items = [(h, i) for h in (0, 1) for i in range(60) if (i + h) % 3]
    df = spark.createDataFrame(items, "hub long, id long")
    got = {tuple(r) for r in vectors._close_within(df, spark.createDataFrame(vecs, "id long, vec array<double>"), 0.9, block=7).collect()}
    cos = lambda a, b: round(sum(x * y for x, y in zip(vecs[a][1], vecs[b][1])), 6)
    assert got == {(h, a, b) for h, a in items for g, b in items if g == h and a < b and cos(a, b) > 0.9}


def test_components_of_a_shuffled_chain_take_few_rounds(spark, monkeypatch):
    n, tables = 300, []
    for name in ("cut_lineage", "kept"):
        real = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda df, *rest, real=real: tables.append(1) or real(df, *rest))
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    got = graph.components(edges)
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in ids}
    assert len(tables) <= 24  # two tables a round
