"""Neighbours, greedy choices, clusters and graph loops against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import clusters, graph
from corpusloom.operators import vectors as v


def table(spark, x):
    return spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def unit(n, d=8, seed=1, groups=5):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, d))
    x = c[rng.integers(groups, size=n)] + 0.4 * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_knn_cells_prune_without_loss(spark):
    x = unit(400)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    for floor in (-1.0, 0.6):
        want = {i: [(int(j), s[i, j]) for j in np.lexsort((np.arange(len(x)), -s[i]))[:5] if s[i, j] >= floor] for i in range(len(x))}
        got = {}
        for r in v.knn(table(spark, x), 5, floor, block=40, pivots=6).collect():
            got.setdefault(r.id, []).append((r.rank, r.other, r.score))
        assert {i: [(o, sc) for _, o, sc in sorted(g)] for i, g in got.items()} == {i: w for i, w in want.items() if w}


def test_suppress_and_diversity_follow_the_greedy_walk(spark):
    x = unit(60, seed=3)
    w = {(h, i): round(float((h * 31 + i * 17) % 97) / 97, 6) for h in range(3) for i in range(60)}
    items = spark.createDataFrame([(h, i, c) for (h, i), c in w.items()], "hub long, id long, w double")
    got = {}
    for r in v.suppress_near_duplicates(items, table(spark, x), 0.8, 60).collect():
        got.setdefault(r.hub, set()).add(r.id)
    for h in range(3):
        kept = []
        for i in sorted(range(60), key=lambda i: (-w[(h, i)], i)):
            if all(round(float(x[i] @ x[k]), 6) <= 0.8 for k in kept):
                kept.append(i)
        assert got[h] == set(kept)
    edges = spark.createDataFrame([(0, i, w[(0, i)]) for i in range(10)], "node long, other long, w double")
    dens = spark.createDataFrame([(i, 0.9) for i in range(60)], "id long, density double")
    acc, picked = 0.0, []
    for i in sorted(range(10), key=lambda i: (-w[(0, i)], i)):
        red = max([min(1, max(0, (float(x[i] @ x[k]) - 0.1) / 0.8)) for k in picked], default=0)
        acc += w[(0, i)] * (1 - red)
        picked.append(i)
    assert abs(v.diversity_sum(edges, table(spark, x), dens, 0.1).first().ds - acc) < 1e-9


def test_pagerank_hits_components(spark):
    e = [(0, 1, 2.0), (0, 2, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 2, 1.0), (1, 4, 3.0)]  # 4 is a dead end
    n = 5
    p, m = np.zeros((n, n)), np.zeros((n, n))
    for s, d, w in e:
        p[d, s] += w / sum(c for a, _, c in e if a == s)
        m[s, d] = w
    r = np.full(n, 1 / n)
    for _ in range(40):
        r = 0.15 / n + 0.85 * (p @ r) + 0.85 * r[4] / n
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    edges = spark.createDataFrame(e, "src long, dst long, w double")
    got = {x.node: x.rank for x in graph.pagerank(nodes, edges).collect()}
    assert np.allclose([got[i] for i in range(n)], r, atol=1e-12)
    h = np.ones(n)
    for _ in range(30):
        a = m.T @ h
        h = m @ a
        a, h = a / np.linalg.norm(a), h / np.linalg.norm(h)
    got = {x.node: (x.authority, x.hub) for x in graph.hits(nodes, edges).collect()}
    assert np.allclose([got[i] for i in range(n)], np.stack([a, h], 1), atol=1e-9)
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "src long, dst long")
    comp = {x.node: x.component for x in graph.components(chain).collect()}
    assert set(comp.values()) == {1, 100} and comp[60] == 1 and comp[101] == 100


def test_communities_find_planted_blocks(spark):
    rng = np.random.default_rng(0)
    e = [(a, b, 1.0) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.7 if a // 10 == b // 10 else 0.03)]
    und = spark.createDataFrame(e, "a long, b long, w double")
    runs, told = graph.local_moving(und, 30, (0, 5, 9, 12))
    for r in range(4):
        comm = runs.filter(F.col("run") == r)
        singles = comm.select("node", F.col("node").alias("community"))
        q, q0 = graph.modularity(und, comm).first()[0], graph.modularity(und, singles).first()[0]
        assert q > 0.4 > q0 and abs(q - told[r]) < 1e-9
    assert max(told.values()) >= walked_modularity(e) - 0.02
    assert graph.partition_agreement(runs).first().agreement > 0.8
    same = comm.drop("run").withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    assert graph.partition_stability(same, comm.select("node")).first().stability == 1.0


def walked_modularity(edges):
    """Local moving one node at a time, in order of the nodes, until none moves."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    deg = {n: sum(x.values()) for n, x in near.items()}
    m2, of, size = sum(deg.values()), {n: n for n in near}, dict(deg)
    moved = True
    while moved:
        moved = False
        for n in sorted(near):
            size[of[n]] -= deg[n]
            link = {of[n]: 0.0}
            for o, w in near[n].items():
                link[of[o]] = link.get(of[o], 0.0) + w
            gain = {c: x - size[c] * deg[n] / m2 for c, x in link.items()}
            best = min(gain, key=lambda c: (-round(gain[c], 9), c != of[n], c))
            moved |= best != of[n]
            of[n] = best
            size[best] += deg[n]
    return sum(w for a, b, w in edges if of[a] == of[b]) * 2 / m2 - sum((s / m2) ** 2 for s in size.values())


def test_local_moving_rests_and_follows_modularity(spark):
    """On a weighted graph with pendant nodes, a bridge and a node without a partner."""
    rng = np.random.default_rng(4)
    e = [(a, b, float(rng.integers(1, 5))) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.5 if a // 12 == b // 12 else 0.02)]
    e += [(59, 60, 1.0), (60, 61, 2.0), (70, 71, 1.0), (80, 80, 9.0)]
    und = spark.createDataFrame(e, "a long, b long, w double")
    comm = graph.best_communities(und)
    got = {r.node: r.community for r in comm.collect()}
    assert 80 not in got and got[70] == got[71]
    e = e[:-1]
    m2 = 2 * sum(w for *_, w in e)
    deg, size = {}, {}
    for a, b, w in e:
        deg[a], deg[b] = deg.get(a, 0) + w, deg.get(b, 0) + w
    for n, d in deg.items():
        size[got[n]] = size.get(got[n], 0) + d
    for n in deg:  # at rest: no node gains by moving alone
        link = {got[n]: 0.0}
        for a, b, w in e:
            if n in (a, b):
                c = got[b if n == a else a]
                link[c] = link.get(c, 0.0) + w
        gain = {c: x - (size[c] - (deg[n] if c == got[n] else 0)) * deg[n] / m2 for c, x in link.items()}
        assert max(gain.values()) <= gain[got[n]] + 1e-6
    assert graph.modularity(und.filter("a <> b"), comm).first()[0] >= walked_modularity(e) - 0.02


def test_agreement_of_partitions_by_pairs(spark):
    rng = np.random.default_rng(1)
    runs = [(r, n, int(rng.integers(0, 4))) for r in range(3) for n in range(30)]
    of = {(r, n): c for r, n, c in runs}
    same = [(of[r, a] == of[r, b]) == (of[0, a] == of[0, b]) for r in (1, 2) for a in range(30) for b in range(a)]
    got = graph.partition_agreement(spark.createDataFrame(runs, "run int, node long, community long")).first()
    assert got.pairs == len(same) and abs(got.agreement - np.mean(same)) < 1e-12


def test_fields_and_sense_split(spark):
    x = unit(80, seed=9, groups=8)
    t = v.cut_lineage(v.knn(table(spark, x), 12, 0.3))
    freq = {i: (i * 37) % 11 for i in range(80)}
    out = clusters.disjoint_fields(t, spark.createDataFrame(list(freq.items()), "id long, freq long"), 0.7).collect()
    near = {}
    for r in t.collect():
        near.setdefault(r.id, []).append((r.score, r.other))
    top = {i: {o for _, o in n} for i, n in near.items()}
    claimed, want = set(), {}
    for s in sorted(range(80), key=lambda i: (-freq[i], i)):
        if s in claimed:
            continue
        got = [o for c, o in sorted(near.get(s, []), key=lambda q: (-q[0], q[1])) if c >= 0.7 and o not in claimed and s in top.get(o, ())][:9]
        if len(got) >= 2:
            want[s] = {s, *got}
            claimed |= want[s]
    fields = {}
    for r in out:
        fields.setdefault(r.seed, set()).add(r.member)
    assert fields == want
    a, b = np.eye(4)[0], np.eye(4)[1]
    rows = [(1, i, [float(z) for z in (a if i < 6 else b)]) for i in range(10)] + [(2, i, [float(z) for z in a]) for i in range(4)]
    split = {r.item: r for r in clusters.sense_split(spark.createDataFrame(rows, "item long, id long, vec array<double>")).collect()}
    assert set(split) == {1} and {split[1].n_a, split[1].n_b} == {4, 6} and abs(split[1].score - 0.667) < 1e-9


def test_clean_up_keeps_every_member(spark):
    x = unit(60, seed=2, groups=3)
    m = table(spark, x).withColumn("cluster", F.when(F.col("id") < 4, F.lit(9)).otherwise(F.col("id") % 2))
    out = clusters.clean_up(m, 5, 0.98).collect()
    assert sorted(r.id for r in out) == list(range(60)) and 9 not in {r.cluster for r in out}


def test_hop_statistics_and_sketches(spark):
    rng = np.random.default_rng(7)
    edges = [(i, i + 1) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(0, 41, (30, 2))] + [(90, 91)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def hops(src):
        dist, todo = {src: 0}, [src]
        for x in todo:
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    todo.append(y)
        return dist

    giant = sorted(n for n in near if n < 90)
    df = spark.createDataFrame(edges, "src long, dst long")
    d = [h for s in giant[::4] for h in hops(s).values() if h]
    got = graph.hop_statistics(df, aim=12).first()
    assert (got.giant, got.sources, got.longest) == (41, len(giant[::4]), max(d)) and abs(got["mean"] - np.mean(d)) < 1e-9
    every = [h for s in near for h in hops(s).values() if h]
    sketch = {r.hops: r.pairs for r in graph.hop_sketches(df).collect()}
    assert abs(sum(sketch.values()) / len(every) - 1) < 0.03
    assert abs(sum(h * n for h, n in sketch.items()) / sum(sketch.values()) / np.mean(every) - 1) < 0.03


def test_pivot_tree_loses_nothing():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = v.PivotTree(x[:30])
    leaf, angle = tree.assign(x)
    tree.measured({int(c): float(angle[leaf == c].max()) for c in np.unique(leaf)})
    s = x @ x.T
    need = np.sort(s, axis=1)[:, -6]
    seen = {(int(r), int(c)) for rows, leaves in tree.reach(x, need) for r, c in zip(rows, leaves)}
    assert all((i, int(leaf[j])) in seen for i, j in zip(*np.nonzero(s >= need[:, None])))
    assert len(seen) < 0.8 * len(x) * len(np.unique(leaf))
    assert len(tree.tops) == 6 and tree.cut[-1] == 30


def test_similar_pairs_through_the_tree(spark):
    x = unit(150, seed=3, groups=6)
    got = {(r.a, r.b): r.score for r in v.similar_pairs(table(spark, x), 0.6, block=20, pivots=9).collect()}
    s = np.round(x @ x.T, 6)
    assert got == {(i, j): s[i, j] for i in range(150) for j in range(i + 1, 150) if s[i, j] >= 0.6}


def test_knn_sends_a_vector_once_per_group(spark):
    """Random vectors of many dimensions, of which no leaf can be ruled out."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def written():
        ex = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(ex.apply(i).totalShuffleWrite() for i in range(ex.size()))

    vecs = v.cut_lineage(table(spark, x))
    before = written()
    got = {}
    for r in v.knn(vecs, 3, block=500).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    assert written() - before < 100e6  # 6,000 vectors of 512 bytes, sent to 78 leaves: 240 MB
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    assert all([o for _, o in sorted(got[i])] == list(np.lexsort((np.arange(len(x)), -s[i]))[:3]) for i in range(0, 6000, 50))


def test_crowded_leaves_and_ties(spark):
    """More equal vectors than a group holds: ties go by the smaller id."""
    x = unit(300, seed=2)
    x[40:240] = x[40]
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    got = {}
    for r in v.knn(table(spark, x), 4, block=30, pivots=5).collect():
        got.setdefault(r.id, []).append((r.rank, r.other, r.score))
    assert {i: [(o, c) for _, o, c in sorted(g)] for i, g in got.items()} == {i: [(int(j), s[i, j]) for j in np.lexsort((np.arange(300), -s[i]))[:4]] for i in range(300)}
    pairs = [(r.a, r.b) for r in v.similar_pairs(table(spark, x), 0.9, block=30, pivots=5).collect()]
    assert sorted(pairs) == [(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.9]


@pytest.mark.parametrize("together", [100_000, 4])
def test_greedy_choice_is_the_walk(spark, together):
    rng = np.random.default_rng(8)
    items = [(h, i, float(rng.integers(0, 6))) for h in (1, 2) for i in range(25)]
    conflicts = [(h, int(a), int(b)) for h in (1, 2) for a, b in rng.integers(0, 25, (14, 2)) if a < b]
    lost, want = set(), []
    for h, i, w in sorted(items, key=lambda x: (-x[2], x[1])):
        if (h, i) not in lost:
            want.append((h, i, w))
            lost |= {(h, b if a == i else a) for k, a, b in conflicts if k == h and i in (a, b)}
    got = v.greedy_independent(spark.createDataFrame(items, "hub long, id long, w double"), spark.createDataFrame(conflicts, "hub long, a long, b long"), together)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_greedy_choice_on_a_long_chain(spark):
    n = 1_000
    items = spark.range(n).select(F.lit(1).cast("long").alias("hub"), "id", (F.lit(float(n)) - F.col("id")).alias("w"))
    chain = spark.range(n - 1).select(F.lit(1).cast("long").alias("hub"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert sorted(r.id for r in v.greedy_independent(items, chain).collect()) == list(range(0, n, 2))
