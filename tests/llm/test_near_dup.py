import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import near_dup as nd

from .conftest import prose


def slow_simhash(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "one", "Two words", "a b c d", "a b c d e", "ÀB c\x1cd e\x85f g h", prose(3, 500)])
def test_simhash_is_the_plain_definition(text):
    assert nd.simhash(text) == slow_simhash(text)


def test_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


def components(fps, radius):
    fps = sorted(set(fps))
    top = {f: f for f in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= radius:
                top[find(a)] = find(b)
    return {f: find(f) for f in fps}


def noisy_fingerprints(seed, centres, copies):
    rng = random.Random(seed)
    out = [0, 2**63, 2**64 - 1]
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(copies):
            f = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            out.append(f)
    return out


@pytest.mark.parametrize("block", [4, 1024])
@pytest.mark.parametrize("radius", [0, 1, 4])
def test_links_connect_what_brute_force_connects(spark, radius, block):
    fps = sorted(set(noisy_fingerprints(radius, 25, 12)))
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    got = {f: f for f in fps}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in nd.links(df, radius, block).collect():
        a, b = r.src & (2**64 - 1), r.dst & (2**64 - 1)
        if radius:
            got[find(a)] = find(b)
    want = components(fps, radius)
    groups = lambda of: sorted(sorted(f for f in fps if of[f] == x) for x in set(of.values()))
    assert groups({f: find(f) for f in fps}) == groups(want)


def test_every_plan_covers_the_radius():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for parts in (2, 3, 5):
        groups = nd.group_bits(np.eye(64) * 100 + 50, 200, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, t = nd.allocate(groups, sample, 10_000, 4)
        assert sum(k + 1 for k in t) == 5


def test_odd_documents(odd_docs, no_docs):
    rows = nd.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = {r.doc_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {3, 4, 5} and {by[k] for k in by if k[1] == "0" * 16} == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    kept = nd.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id or -1) for r in kept.select("doc_id").collect())
    assert ids == [-1, 1, 3, 6, 8, 9, 9, 10, 11, 12]
    assert nd.near_duplicates(no_docs).count() == 0 and nd.drop_near_duplicates(no_docs).count() == 0


def test_query_is_brute_force(spark):
    from corpusloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_near_dup"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    fp = {r.doc_id: slow_simhash(r.text) for r in docs}
    comp = components(fp.values(), 4)
    first = {}
    for d in sorted(fp):
        first.setdefault(comp[fp[d]], d)
    assert got == {d: (f"{f:016x}", first[comp[f]]) for d, f in fp.items()}
