"""Ordered and pairwise helpers against plain Python, with one group that holds most rows."""

import itertools
import random

from pyspark.sql import functions as F

from corpusloom.functions import scale
from corpusloom.operators import model, pairs


def skewed(spark, n=3000):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.7 else rng.randrange(2, 30), i, rng.randrange(10)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "grp long, pos long, v long")


def test_scan_matches_running_totals(spark):
    rows, df = skewed(spark)
    got = {(r.grp, r.pos): (r.s, r.m, r.b) for r in scale.scan(
        scale.scan(df, ["grp"], ["pos"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}), ["grp"], ["pos"], {"b": ("min", F.col("v"))}, before_only=True).collect()}
    seen = {}
    for g, p, v in rows:
        past = seen.setdefault(g, [])
        assert got[(g, p)] == (sum(past) + v, max([*past, v]), min(past) if past else None)
        past.append(v)


def test_ordinal_and_neighbours(spark):
    rows, df = skewed(spark, 800)
    order = sorted(rows)
    assert {(r.grp, r.pos): r.rn for r in scale.ordinal(df, ["grp", "pos"]).collect()} == {(g, p): i for i, (g, p, _) in enumerate(order, 1)}
    near = {(r.grp, r.pos): r.near for r in scale.neighbours(df, ["grp"], ["pos"], ["v"], 2, 1).collect()}
    for g, items in itertools.groupby(order, key=lambda r: r[0]):
        items = list(items)
        for i, (_, p, _) in enumerate(items):
            want = {d: items[i + d][2] for d in (-2, -1, 0, 1) if 0 <= i + d < len(items)}
            assert {k: v["v"] for k, v in near[(g, p)].items()} == want


def test_pairs_within_blocks_equals_brute_force(spark):
    rng = random.Random(3)
    members = {(g, rng.randrange(60)) for g in range(40) for _ in range(25)} | {(g, i) for g in (100, 101, 102) for i in range(60)}
    df = spark.createDataFrame(sorted(members), "g long, i long")
    want = {}
    for g in {m[0] for m in members}:
        for a, b in itertools.combinations(sorted(i for x, i in members if x == g), 2):
            want[(a, b)] = want.get((a, b), 0) + 1
    for cell in (512, 16):
        got = {(r.a, r.b): r.n for r in scale.pairs_within(df, "g", "i", cell).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
        assert got == want
    t = df.select(F.col("g").alias("unit_id"), F.col("i").alias("key"))
    assert {(r.a, r.b): r.weight for r in pairs.cooccurrence(t, 5, cell=16).collect()} == {k: n for k, n in want.items() if n >= 5}


def test_collect_chunked_bounds_and_keeps_all(spark):
    df = spark.createDataFrame([(1, i) for i in range(95)] + [(2, 7)], "k long, v long")
    out = scale.collect_chunked(df, ["k"], ["v"], {"vs": F.col("v")}, 10).collect()
    assert max(len(r.vs) for r in out) == 10
    assert sorted(v for r in out if r.k == 1 for v in r.vs) == list(range(95))


def test_range_repairs(spark):
    merged = model.merge_ranges(spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 5, 5), (1, 9, 9), (2, 2, 2)], "grp long, first long, last long"))
    assert sorted((r.grp, r["first"], r["last"]) for r in merged.collect()) == [(1, 1, 6), (1, 9, 9), (2, 2, 2)]
    raw = spark.createDataFrame([(1, 1, 5, 2), (1, 2, 4, 8), (1, 3, 12, 20), (1, 4, 5, 6), (2, 5, 3, 4)], "grp long, id long, first int, last int")
    sizes = spark.createDataFrame([(1, 10), (2, 6)], "grp long, size int")
    tiles, fixes = model.tile_ranges(raw, sizes)
    assert sorted((r.grp, r["first"], r["last"], r.id) for r in tiles.collect()) == [(1, 1, 5, 1), (1, 6, 10, 2), (2, 1, 6, 5)]
    assert {r.kind: r.n for r in fixes.collect()} == {"swap": 1, "clamp": 1, "outside": 1, "overlap": 2, "covered": 1, "gap": 4}
    runs = model.collapse_runs(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 5, "a"), (1, 6, "b"), (2, 1, "b")], "grp long, pos long, text string"), "text")
    assert sorted((r.grp, r["first"], r["last"], r.text) for r in runs.collect()) == [(1, 1, 5, "a"), (1, 6, 6, "b"), (2, 1, 1, "b")]
