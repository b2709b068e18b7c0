"""Merkle manifest against a plain tree in Python, with small blocks so that
versions pass several rounds."""

from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from corpusloom.llm import merkle_versions as M

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def hashed(s):
    return sha256(s.encode()).hexdigest()


def slow_leaf(d, text):
    return hashed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))


def slow_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashed("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def slow_manifest(docs):
    of = defaultdict(list)
    for d in docs:
        of[d["source"]].append(d)
    order = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        of[s].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, slow_leaf(d, d["text"])))
    trees = {s: slow_tree([slow_leaf(d, d["text"]) for d in of[s]]) for s in order}
    top = slow_tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, d in enumerate(of[s]):
            hit = crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 2 == 0
            leaf = slow_leaf(d, d["text"])
            node = slow_leaf(d, d["text"].replace("\n", "")) if hit and d["text"] is not None else leaf
            proof = ""
            for tree, j in ((trees[s], i), (top, at)):
                for level in tree[:-1]:
                    a = j - j % 3
                    left, right = "".join(level[a:j]), "".join(level[j + 1 : a + 3])
                    proof, node, j = proof + left + right, hashed(left + node + right), j // 3
            out.append((d["doc_id"], leaf, trees[s][-1][0], top[-1][0], hashed(proof), node, node == top[-1][0]))
    return out, trees, order


def key(row):
    return tuple((x is not None, x) for x in row)


def made(n, sources):
    return [{"doc_id": (i * 7919) % 1000, "source": sources[i % len(sources)] if i % 3 else sources[0], "lang": None if i % 5 == 0 else "en", "n_chars": None if i % 7 == 0 else i, "text": None if i % 11 == 0 else "line\n" * (i % 4) + str(i)} for i in range(n)]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (2, ["a"]), (10, [None]), (40, ["a", "é", None, "z"]), (271, ["a", "b", None]), (60, [f"s{i}" for i in range(30)])])
def test_against_plain_tree(spark, n, sources):
    docs = made(n, sources)
    df = spark.createDataFrame([tuple(d.values()) for d in docs], COLUMNS)
    got = [tuple(r) for r in M.digests(M.manifest(M.without_line_feeds(df), 2)).collect()]
    want, trees, order = slow_manifest([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in df.collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    nodes = {(r.tree, r.level, r.idx): r.hash for r in M.source_nodes(M.leaves(M.without_line_feeds(df)), 2).collect()}
    assert nodes == {("n" if s is None else "s" + s, k, i): h for s in order for k, level in enumerate(trees[s]) for i, h in enumerate(level)}


def test_a_version_is_the_tree_with_its_leaf_changed(spark):
    docs = made(120, ["a", "b"])
    df = spark.createDataFrame([tuple(d.values()) for d in docs], COLUMNS)
    rows = M.manifest(M.without_line_feeds(df), 2)
    base = {(r.tree, r.level, r.idx): r.hash for r in M.source_nodes(M.leaves(M.without_line_feeds(df)), 2).collect()}
    sizes = defaultdict(int)
    for t, level, i in base:
        sizes[t, level] = max(sizes[t, level], i + 1)
    of = {(r.tree, r.idx): r for r in rows.collect()}
    versions = defaultdict(dict)
    for r in M.version_nodes(rows).collect():
        versions[r.tree, r.version][r.level, r.idx] = r.hash
    assert set(versions) == {k for k, r in of.items() if r.hit}
    by_id = {d["doc_id"]: d for d in docs}
    for (tree, i), copied in list(versions.items())[:12]:
        d = by_id[of[tree, i].doc_id]
        nodes = [base[tree, 0, j] for j in range(sizes[tree, 0])]
        nodes[i] = slow_leaf(d, d["text"] and d["text"].replace("\n", ""))
        for k, level in enumerate(slow_tree(nodes)[1:], 1):
            assert level == [copied.get((k, j), base[tree, k, j]) for j in range(len(level))]
            assert [j for (lv, j) in copied if lv == k] == [i // 3**k]


def test_odd_rows(spark, odd_docs, no_docs):
    got = [tuple(r) for r in M.digests(M.manifest(M.without_line_feeds(odd_docs))).collect()]
    want, _, _ = slow_manifest([{c: r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")} for r in odd_docs.collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert M.digests(M.manifest(M.without_line_feeds(no_docs))).collect() == []
