import random

import corpus_pipeline as cp
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import shingle_dup as sd

from .conftest import with_clashes


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def slow_labels(rows):
    """Smallest row number reachable over pairs of Jaccard 0.8 or more, by all pairs."""
    s = [sets(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if 5 * both >= 4 * (len(s[i]) + len(s[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(i) for i in range(len(rows))]


def copies(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    shared = [word() for _ in range(60)]
    texts = ["", None, "one", "one two", "ONE  two"]
    for n in (6, 30, 80, 200, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for changes in (0, 1, 2, max(1, n // 60), max(1, n // 45), max(1, n // 30)):
                new = list(base)
                for p in rng.sample(range(n), min(n, changes)):
                    new[p] = word()
                texts.append(" ".join(new))
    for _ in range(12):
        texts.append(" ".join([*(word() for _ in range(20)), *shared]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("one_in,least", [(8, 3), (1, 1)])
def test_pipeline_stage_is_brute_force_jaccard(spark, one_in, least):
    rows = copies(one_in)
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id for r in sd.drop_near_copies(docs, one_in=one_in, least=least).collect()}
    assert got == set(slow_labels(rows))
    if one_in == 8:
        assert {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()} == got


def test_planted_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()} == {rows[i][0] for i in slow_labels(rows)}


def test_odd_documents(odd_docs, no_docs):
    kept = sd.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or -1) for r in kept.select("doc_id").collect()) == [-1, 1, 3, 6, 8, 9, 9, 10, 11, 12]
    assert sd.drop_near_copies(no_docs).count() == 0


@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=150), st.sets(st.integers(0, (1 << 64) - 1), max_size=150), st.sets(st.integers(0, (1 << 64) - 1), max_size=150))
@settings(max_examples=300, deadline=None)
def test_parities_never_exceed_the_difference(shared, left, right):
    a, b = (np.array(sorted(shared | x), dtype=np.uint64) for x in (left, right))
    d = len(np.setxor1d(a, b))
    assert sd.least_difference(sd.parities(a), sd.parities(b)) <= d
    if sd.similar(a, b):
        assert sd.may_link(len(a), sd.parities(a), len(b), sd.parities(b)) is not None
        assert set(sd.prefix(a, a[:3])) & set(sd.prefix(b, a[:3])) or not len(a)


def long_lists():
    """Documents that share most of one passage in sizes that do not link, with groups among them."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(40)]
    texts = []
    for i in range(60):
        own = [f"w{i}x{j}" for j in range(rng.choice([2, 3, 9, 14]))]
        texts.append(" ".join([*shared, *own]))
        if i % 6 == 0:
            texts.append(" ".join([*shared, *own[:-1], "z"]))
    return list(enumerate(texts))


@pytest.mark.parametrize("members", [8, 2048])
def test_shingles_of_very_many_documents(spark, monkeypatch, members):
    monkeypatch.setattr(sd, "MEMBERS", members)  # blocks are dealt by the driver
    rows = long_lists()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in sd.drop_near_copies(docs, one_in=1).collect()} == set(slow_labels(rows))


def test_long_list_pairs_alone(spark, monkeypatch):
    """Every pair of different components in a list, and none twice, whatever the blocks."""
    monkeypatch.setattr(sd, "MEMBERS", 3)
    sets = [sd.shingles(t) for _, t in long_lists()]
    nodes = spark.createDataFrame([(i, len(s), sd.parities(s)) for i, s in enumerate(sets)], "node long, n int, sig binary")
    members = spark.createDataFrame([(7, i) for i in range(len(sets))] + [(8, i) for i in range(len(sets))] + [(9, 0), (9, 1)], "a long, b long")
    comp = spark.createDataFrame([(i, 0) for i in range(5)], "node long, component long")
    got = sorted((r.src, r.dst) for r in sd.long_list_pairs(members, nodes, comp).collect())
    fit = lambda i, j: sd.may_link(len(sets[i]), sd.parities(sets[i]), len(sets[j]), sd.parities(sets[j])) is not None
    want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if not (i < 5 and j < 5) and fit(i, j)]
    assert got == want
    near = {(r.src, r.dst) for r in sd.long_list_pairs(members, nodes, comp, nearest=True).collect()}
    least = lambda i, j: sd.least_difference(sd.parities(sets[i]), sd.parities(sets[j]))
    assert near <= set(want)
    for i in {x for p in want for x in p}:
        d = min(least(*p) for p in want if i in p)
        assert any(least(*p) == d for p in near if i in p)
