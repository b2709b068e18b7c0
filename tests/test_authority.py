"""Operators without an SQL twin beside plain Python."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.operators import clusters, graph


def unit_vectors(seed, n, dims=4):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(dims)]
        size = math.sqrt(sum(x * x for x in v))
        out[i] = [x / size for x in v]
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def test_damped_flow(spark):
    rng = random.Random(3)
    edges = [(a, b, rng.random()) for a in range(12) for b in range(12) if a != b and rng.random() < 0.25]
    prior = {i: rng.random() for i in range(12)}
    got = {r.node: r.score for r in graph.damped_flow(spark.createDataFrame(list(prior.items()), "node long, prior double"), spark.createDataFrame(edges, "src long, dst long, w double"), 0.35, 10).collect()}
    out = defaultdict(float)
    for a, _, w in edges:
        out[a] += w
    score = dict(prior)
    for _ in range(10):
        score = {i: prior[i] + 0.35 * sum(score[a] * w / out[a] for a, b, w in edges if b == i) for i in prior}
    assert got == {i: pytest.approx(s) for i, s in score.items()}


def direct(rows, ds, floor, margin):
    """The rule for one pair: a clear containment takes all, else eligible sides share."""
    out = []
    for a, b, cos, f, ab, ba in rows:
        da, db = ds.get(a, 0.0), ds.get(b, 0.0)
        total = da * da + db * db
        share = da * da / (total or 1.0)
        ok_a, ok_b = ab is not None and ab >= floor, ba is not None and ba >= floor
        clear_a = ok_a and (ba is None or round(ab - ba, 9) >= margin)
        clear_b = not clear_a and ok_b and (ab is None or round(ba - ab, 9) >= margin)
        if clear_a:
            out.append((b, a, f * (0.5 + 0.5 * ab)))
        elif clear_b:
            out.append((a, b, f * (0.5 + 0.5 * ba)))
        else:
            if ok_a:
                out.append((b, a, f * (0.5 + 0.5 * ab) * share))
            if ok_b:
                out.append((a, b, f * (0.5 + 0.5 * ba) * (1 - share)))
    return {(s, d): pytest.approx(w) for s, d, w in out}


def test_contained_and_soft_edges(spark):
    rng = random.Random(5)
    pick = lambda: rng.choice([None, 0.0, 0.25, 0.3, 0.4, 0.9])
    rows = [(a, b, rng.random(), rng.random(), pick(), pick()) for a in range(9) for b in range(a + 1, 9)]
    ds = {i: rng.random() for i in range(7)} | {6: 0.0}
    s = spark.createDataFrame(rows, "a long, b long, cos double, f double, c_ab double, c_ba double")
    d = spark.createDataFrame(list(ds.items()), "node long, ds double")
    assert {(r.src, r.dst): r.w for r in graph.contained_edges(s, d, 0.3, 0.1).collect()} == direct(rows, ds, 0.3, 0.1)
    free = [(a, b, cos, f, 1.0, 1.0) for a, b, cos, f, _, _ in rows]
    assert {(r.src, r.dst): r.w for r in graph.soft_edges(s.drop("c_ab", "c_ba"), d).collect()} == direct(free, ds, 0.0, 2.0)


def test_length_directed(spark):
    rng = random.Random(6)
    lens = {i: rng.randint(1, 5) for i in range(10)}
    pairs = [(a, b, rng.random(), rng.choice([None, 0.1, 0.2, 0.7]), rng.choice([None, 0.1, 0.2, 0.7])) for a in range(10) for b in range(a + 1, 10)]
    und = spark.createDataFrame([(a, b, w) for a, b, w, _, _ in pairs], "a long, b long, w double")
    ratio = spark.createDataFrame([(a, b, x, y) for a, b, _, x, y in pairs], "a long, b long, c_ab double, c_ba double")
    got = {(r.src, r.dst): r.w for r in graph.length_directed(und, spark.createDataFrame(list(lens.items()), "id long, len long"), ratio, 0.2).collect()}
    want = {}
    for a, b, w, ab, ba in pairs:
        if lens[a] != lens[b]:
            c, src, dst = (ab, b, a) if lens[a] < lens[b] else (ba, a, b)
            c = 1.0 if c is None else c
            if c >= 0.2:
                want[src, dst] = pytest.approx(c * w)
    assert got == want


def test_diversity_authority(spark):
    rng = random.Random(7)
    vecs = unit_vectors(8, 40)
    parts = [(i, rng.randint(3, 20), rng.random() * 5, rng.random(), rng.random(), rng.random()) for i in range(40)]
    scored, table = graph.diversity_authority(spark.createDataFrame(parts, "node long, n long, strength double, dispersion double, group_ratio double, key_ratio double"), spark.createDataFrame(list(vecs.items()), "id long, vec array<double>"), most=10)
    want, chosen = {}, []
    for name, x, y, z in graph.EXPONENTS:
        s = {i: round(st * d**x * g**y * k**z, 9) for i, _, st, d, g, k in parts}
        lead = sorted(s, key=lambda i: (-s[i], i))[:10]
        cos = [dot(vecs[a], vecs[b]) for k, a in enumerate(lead) for b in lead[:k]]
        degree = sorted(parts[i][1] for i in lead)[5]
        want[name] = (degree, pytest.approx(sum(cos) / len(cos) + sum(c > 0.7 for c in cos) / len(cos), abs=1e-5))
        if degree >= 8:
            chosen.append((round(sum(cos) / len(cos) + sum(c > 0.7 for c in cos) / len(cos), 6), name))
    rows = table.collect()
    assert {r.combo: (r.median_degree, r.redundancy) for r in rows} == want
    assert [r.combo for r in rows if r.chosen] == ([min(chosen)[1]] if chosen else [])
    assert scored.count() == 240


def test_null_model_keeps_degrees(spark):
    rng = random.Random(9)
    links = [(s, d) for s in range(20) for d in rng.sample(range(30), 6)]
    theme = {d: d % 5 for d in range(30)}
    df = spark.createDataFrame(links, "src long, dst long")
    themes = spark.createDataFrame(list(theme.items()), "id long, theme long")
    rows = {r.run: r.top for r in graph.null_model(df, themes, 4, runs=6).collect()}
    real = sum(len({theme[d] for s2, d in links if s2 == s}) >= 4 for s in range(20))
    assert rows[0] == real and sorted(rows) == list(range(7)) and all(0 <= t <= 20 for t in rows.values())
    # one source takes all targets in every shuffle
    one = {r.run: r.top for r in graph.null_model(spark.createDataFrame([(1, d) for d in range(30)], "src long, dst long"), themes, 5, runs=3).collect()}
    assert one == {0: 1, 1: 1, 2: 1, 3: 1}


def test_kmeans_assigns_the_nearest_centroid(spark):
    vecs = unit_vectors(10, 120)
    members, cents = clusters.spherical_kmeans(spark.createDataFrame(list(vecs.items()), "id long, vec array<double>"), 5)
    c = {r.cluster: r.centroid for r in cents.collect()}
    got = {r.id: r.cluster for r in members.collect()}
    assert sorted(got) == sorted(vecs) and len(c) <= 5
    for i, k in got.items():
        assert dot(vecs[i], c[k]) >= max(dot(vecs[i], x) for x in c.values()) - 1e-9
    for k in c:  # a centroid is the direction of the sum of its members
        total = [sum(vecs[i][j] for i in got if got[i] == k) for j in range(4)]
        assert dot(total, c[k]) == pytest.approx(math.sqrt(dot(total, total)), rel=1e-3)


def test_farthest_points(spark):
    vecs = unit_vectors(11, 50)
    got = [r.seed for r in clusters.farthest_points(spark.createDataFrame(list(vecs.items()), "id long, vec array<double>"), 0, 6).orderBy("pick").collect()]
    picks = [0]
    while len(picks) < 6:
        far = {i: min([2.0] + [round(1 - dot(vecs[i], vecs[p]), 6) for p in picks]) for i in vecs}
        picks.append(min(far, key=lambda i: (-far[i], i)))
    assert got == picks


def test_two_level(spark):
    vecs = unit_vectors(12, 90)
    rows = clusters.two_level(spark.createDataFrame(list(vecs.items()), "id long, vec array<double>"), 8, 3).collect()
    assert sorted(r.id for r in rows) == sorted(vecs)
    section = defaultdict(set)
    for r in rows:
        section[r.topic].add(r.section)
    assert all(len(s) == 1 for s in section.values()) and len(set.union(*section.values())) <= 3
    for t in section:
        mine = [r for r in rows if r.topic == t]
        centre = [r.id for r in mine if r.is_center]
        total = [sum(vecs[r.id][j] for r in mine) for j in range(4)]
        best = max(dot(vecs[r.id], total) for r in mine)
        assert len(centre) == 1 and dot(vecs[centre[0]], total) >= best - 0.05 * math.sqrt(dot(total, total))


def test_kmeans_equals_plain_rounds_from_fixed_starts(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(90, 5)) + np.repeat(rng.normal(size=(6, 5)) * 2, 15, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.integers(1, 4, 90).astype(float)
    start = np.vstack([x[:5], -x.mean(axis=0) / np.linalg.norm(x.mean(axis=0))])
    for weight in (None, w):
        c, before = start.copy(), None
        for _ in range(40):
            at = np.round(x @ c.T, 9).argmax(1)
            for j in range(len(c)):
                t = (x * (1.0 if weight is None else weight[:, None]))[at == j].sum(axis=0)
                if (at == j).any():
                    c[j] = t / np.linalg.norm(t)
            if before is not None and (at == before).all():
                break
            before = at
        rows = [(i, x[i].tolist(), float(w[i])) for i in range(90)]
        df = spark.createDataFrame(rows, "id long, vec array<double>, w double")
        members, cents = clusters.spherical_kmeans(df, 6, weight=None if weight is None else "w", start=start)
        assert {r.id: r.cluster for r in members.collect()} == dict(enumerate(at.tolist()))
        assert np.allclose([r.centroid for r in cents.orderBy("cluster").collect()], c)
    moved, _ = clusters.spherical_kmeans(df, 6, start=np.vstack([x[:5], [-10.0, -10, -10, -10, -10]]) / 1, empty="farthest")
    assert moved.select("cluster").distinct().count() == 6


def test_starts_of_kmeans(spark):
    x = np.vstack([np.repeat(np.eye(4), 10, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    for how in ("++", "farthest"):
        assert sorted(map(tuple, clusters.starts(df, 4, how))) == sorted(map(tuple, np.eye(4)))
    assert clusters.starts(df, 6, "shuffle").shape == (6, 4)
    draws = [int(clusters.starts(df, 1, "++", seed=s)[0].argmax()) for s in range(12)]
    assert len(set(draws)) > 1
