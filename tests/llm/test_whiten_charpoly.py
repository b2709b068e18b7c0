"""Whitening against plain definitions: determinants by expansion, numpy's
eigenvalues, whole-number sums of all rows."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import queries
from corpusloom.llm import whiten_charpoly as W

SF = "/root/testdata/sf0.01"


def slow_polynomial(a):
    """Faddeev-LeVerrier in fractions, lowest coefficient first."""
    n = len(a)
    m, c = [[Fraction(0)] * n for _ in range(n)], [Fraction(0)] * n + [Fraction(1)]
    for k in range(1, n + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(n)) + (c[n - k + 1] if i == j else 0) for j in range(n)] for i in range(n)]
        c[n - k] = -sum(a[i][t] * m[t][i] for i in range(n) for t in range(n)) / k
    return [int(x) for x in c]


def gram(rows):
    return (np.array(rows, dtype=object).T @ np.array(rows, dtype=object)).tolist()


small = st.integers(1, 6).flatmap(lambda d: st.lists(st.lists(st.integers(-40, 40), min_size=d, max_size=d), min_size=1, max_size=7))


@given(small)
@settings(max_examples=60, deadline=None)
def test_polynomial_modulo_a_prime(rows):
    a, p = gram(rows), (1 << 31) - 1
    assert W.polynomial_modulo(np.array(a, dtype=object), p).tolist() == [c % p for c in slow_polynomial(a)]


@given(small)
@settings(max_examples=60, deadline=None)
def test_roots_and_null_vectors(rows):
    a = gram(rows)
    f = slow_polynomial(a)
    want = sorted((x for x in np.linalg.eigvalsh(np.array(a, float)) if x > 1e-6), reverse=True)
    found = W.largest_roots(f, len(a))
    assert np.allclose([float(r) for r, n in found for _ in range(n)], want, rtol=1e-7)
    for root, n in found:
        v = np.array(W.null_vectors(a, root, n))
        assert np.allclose(v @ v.T, np.eye(n), atol=1e-14)
        assert np.abs(np.array(a, float) @ v.T - float(root) * v.T).max() <= 1e-12 * max(float(found[0][0]), 1)


def test_equal_and_nearly_equal_roots():
    f = [1]
    roots = [10**30, 10**30, 10**30 - 1, 7, 7, 7, 1, 0, 0]
    for r in roots:
        f = [a - r * b for a, b in zip([0, *f], [*f, 0])]
    found = W.largest_roots(f, 6)
    assert [(round(r), n) for r, n in found] == [(10**30, 2), (10**30 - 1, 1), (7, 3)]
    assert [n for _, n in W.largest_roots(f, 9)] == [2, 1, 3, 1]


def test_exact_products_of_large_numbers():
    z = np.array([[W.LARGEST, -3], [-W.LARGEST, 2], [1, W.LARGEST - 1]] * 3000, dtype=np.int64)
    o = z.astype(object)
    total = W.exact_products(z)
    assert (total == o.T @ o).all()
    assert [sum(c[i] << (W.LIMB * k) for k, c in enumerate(W.to_limbs([int(x) for x in total.ravel()]))) for i in range(4)] == total.ravel().tolist()


def test_primes():
    assert [p for p in range(2000) if W.is_prime(p)] == [p for p in range(2, 2000) if all(p % q for q in range(2, p))]


def slow_whitening(ids, x, most=8):
    x = np.array(x, dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    c = (x - 100_000).astype(float)
    c -= c.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return deviation, c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_query_against_numpy(spark):
    got = queries.op11(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for c, t in got.dtypes if c in ("component", "n", "deviation")] == ["int", "bigint", "bigint"]
    rows = {(r.vec_id, r.component): r for r in got.collect()}
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = [np.floor(np.array(r.embedding, float) * 1024).astype(int) + 100_000 for r in table]
    deviation, white, explained = slow_whitening([r.vec_id for r in table], x)
    assert len(rows) == 8 * len(table)
    signs = {k: np.sign(rows[table[0].vec_id, k].whitened * white[0, k - 1]) for k in range(1, 9)}
    for i, r in enumerate(table):
        for k in range(1, 9):
            g = rows[r.vec_id, k]
            assert g.deviation == deviation[i] and g.n == len(table) and g.identity_error < 1e-9
            assert abs(g.whitened * signs[k] - white[i, k - 1]) < 1e-9 and abs(g.explained / explained[k - 1] - 1) < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, 0.0], 1), (1, [0.5, 0.25, 0.0], 1), (2, None, 1), (3, [0.1, None, 0.2], 1), (4, [nan, 0.0, 0.0], 1), (5, [0.0, -inf, 0.0], 1),
            (None, [-0.5, 0.1, 0.7], 1), (6, [0.3, 0.2, 0.1], 1), (7, [0.3, 0.2], 1), (8, [], 1), (9, [0.9, -0.9, 0.5], None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, component int, whitened int")
    got = W.whiten(df).collect()
    kept = [r for r in rows if r[0] in (1, None, 6, 9)]
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((r[0] or 0, k) for r in kept for k in (1, 2, 3))
    x = [np.floor(np.array(r[1], np.float32).astype(float) * 1024).astype(int) + 100_000 for r in kept]
    deviation, white, _ = slow_whitening(None, x, 3)
    of = {(r.vec_id, r.component): r for r in got}
    for i, r in enumerate(kept):
        assert int(of[r[0], 1].deviation) == deviation[i]
        assert np.allclose([abs(of[r[0], k].whitened) for k in (1, 2, 3)], np.abs(white[i]), atol=1e-9)


def test_huge_entries_and_no_variance(spark):
    df = spark.createDataFrame([(1, [1e30, 2.0]), (2, [-1e30, 1.0]), (3, [0.0, 9.5])], "vec_id long, embedding array<double>")
    got = W.whiten(df).collect()
    assert len(got) == 6 and got[0].identity_error < 1e-4
    assert {r.deviation for r in got if r.vec_id == 3} == {(3 * 9728 - (2048 + 1024 + 9728)) ** 2}
    assert all(r.deviation is None for r in got if r.vec_id != 3)  # 2^126 and more
    for rows in ([], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, []), (2, [])], [(1, None)]):
        out = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert out.collect() == [] and "whitened" in out.columns


@pytest.mark.parametrize("largest", [1, 1 << 20, 1 << 45])
def test_deviation_parts(largest):
    rng = np.random.default_rng(3)
    y = rng.integers(-largest, largest + 1, size=(5, 4))
    n, sums = 1000, [int(s) for s in rng.integers(-largest * 900, largest * 900 + 1, size=4)]
    a, b, c, e = W.deviation_parts(y, n, sums)
    for i, row in enumerate(y.tolist()):
        assert (int(a[i]) << 62) + (int(b[i]) << 32) + (int(c[i]) << 31) + int(e[i]) == sum((n * v - s) ** 2 for v, s in zip(row, sums))
