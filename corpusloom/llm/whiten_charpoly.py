"""Embedding whitening by the exact characteristic polynomial.

An entry c counts as the whole number floor(1024 c) + 100000.  The scatter
n * sum(x x^T) - S S^T is then a matrix of whole numbers, summed over all rows
in Spark without rounding.  Its characteristic polynomial is found modulo many
primes (reduction to Hessenberg form; the primes are dealt over tasks) and
lifted by Chinese remainders to its exact coefficients.  All its roots are
real, so the sign changes of the polynomial shifted by a tell exactly how many
roots exceed a: the largest roots are isolated and refined to ``ROOT_BITS``
bits, equal ones with their multiplicity.  Components are null vectors of the
scatter less a root, by inverse iteration in whole-number fixed point.

What the driver holds grows with the dimension only, never with the rows.

Defined results: a vector that is null, or holds null, nan or infinity, is
dropped, as is one of another length than most have (of equally frequent
lengths the longest counts).  An entry too large for a long counts as the
largest magnitude 2^62.  A component without variance cannot be whitened and
is left out, so one row alone, or equal vectors only, give an empty result, as
an empty table does.  Null and repeated ids are rows like any other; columns
other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb, isqrt, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
ROOT_BITS = 120
FIXED = 448  # bits after the point in inverse iteration
LARGEST = 1 << 62
LIMB, LIMBS = 32, 7  # sums travel as whole numbers of 7 x 32 bits
CHUNK = 8192  # rows of 20 bits whose products a double sums without rounding


def clean(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding as doubles) of the vectors that count, and their length."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    often = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = often.d if often else 0
    return rows.filter(F.size("embedding") == dim), dim


def whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Rows of floor(1024 c), the entries before the shift."""
    c = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore"):
        y = np.floor(c * SCALE)
    big = np.abs(y) >= LARGEST
    out = np.where(big, 0, y).astype(np.int64)
    return np.where(big, np.sign(y).astype(np.int64) * LARGEST, out) if big.any() else out


def exact_products(z: np.ndarray) -> np.ndarray:
    """z^T z of whole numbers, as Python integers."""
    total = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    for lo in range(0, len(z), CHUNK):
        part = z[lo : lo + CHUNK]
        limbs = []
        while not limbs or part.any():
            low = ((part + (1 << 19)) & ((1 << 20) - 1)) - (1 << 19)  # -2^19 to 2^19 - 1
            limbs.append(low.astype(np.float64))
            part = (part - low) >> 20
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (20 * (i + j))
    return total


def to_limbs(values: list[int]) -> list[list[int]]:
    """Columns of 32 bits each; the last carries the sign."""
    mask = (1 << LIMB) - 1
    return [[(v >> (LIMB * k)) & mask if k + 1 < LIMBS else v >> (LIMB * k) for v in values] for k in range(LIMBS)]


def scatter_sums(rows: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of y and the sums of y y^T, exact."""
    pairs = [(i, j) for i in range(dim + 1) for j in range(i, dim + 1)]
    names = [f"l{k}" for k in range(LIMBS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1), dtype=object)
        for b in batches:
            y = whole(b, dim)
            total += exact_products(np.column_stack([np.ones(len(y), np.int64), y]))
        columns = to_limbs([int(total[i, j]) for i, j in pairs])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], ["cell", *names])

    partial = rows.mapInArrow(run, "cell int, " + ", ".join(f"{n} long" for n in names))
    both = [[0] * (dim + 1) for _ in range(dim + 1)]
    for r in partial.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names]).collect():
        i, j = pairs[r.cell]
        both[i][j] = both[j][i] = sum(r[n] << (LIMB * k) for k, n in enumerate(names))
    return both[0][0], both[0][1:], [row[1:] for row in both[1:]]


def is_prime(p: int) -> bool:
    """Exact below 2^32."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7)):
        return p in (2, 3, 5, 7)
    d, s = p - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, p)
        if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes below 2^31 whose product exceeds 2^bits."""
    out, size, p = [], 0.0, 1 << 31
    while size <= bits:
        p -= 1
        if is_prime(p):
            out.append(p)
            size += 30.9
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """det(x I - matrix) modulo p, lowest coefficient first."""
    a = (matrix % p).astype(np.int64)
    d = len(a)
    for m in range(1, d - 1):
        below = np.flatnonzero(a[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            a[[i, m]] = a[[m, i]]
            a[:, [i, m]] = a[:, [m, i]]
        u = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - u[:, None] * a[m]) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * u % p).sum(axis=1)) % p
    f = np.zeros((d + 1, d + 1), dtype=np.int64)
    f[0, 0] = 1
    for k in range(d):
        factors = np.zeros(k + 1, dtype=np.int64)
        chain = 1
        for i in range(k, -1, -1):
            factors[i] = int(a[i, k]) * chain % p
            if not chain:
                break
            chain = chain * int(a[i, i - 1]) % p if i else chain
        f[k + 1, 1:] = f[k, :-1]
        f[k + 1] = (f[k + 1] - (factors[:, None] * f[: k + 1] % p).sum(axis=0)) % p
    return f[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """det(x I - matrix) of a positive semidefinite matrix of whole numbers, lowest first.

    By Maclaurin's inequality coefficient k is at most C(d, k) (trace / d)^k.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_for(bound.bit_length() + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(matrix, dtype=object)
        for b in batches:
            ps = b.column("p").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([polynomial_modulo(c, p) for p in ps], pa.list_(pa.int64()))], ["p", "f"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long")
    coefficients, modulus = [0] * (d + 1), 1
    for r in dealt.mapInArrow(run, "p long, f array<long>").collect():
        inverse = pow(modulus, -1, r.p)
        coefficients = [x + modulus * ((v - x) * inverse % r.p) for x, v in zip(coefficients, r.f)]
        modulus *= r.p
    return [x - modulus if 2 * x > modulus else x for x in coefficients]


def roots_above(f: list[int], m: int, s: int) -> int:
    """How many roots of ``f``, all of them real, exceed m / 2^s, with multiplicity."""
    d = len(f) - 1
    q = [c << (s * (d - i)) for i, c in enumerate(f)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            q[j] += m * q[j + 1]
    signs = [c > 0 for c in q if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(f: list[int], m: int, s: int) -> int:
    value, d = 0, len(f) - 1
    for i in range(d, -1, -1):
        value = value * m + (f[i] << (s * (d - i)))
    return (value > 0) - (value < 0)


def largest_roots(f: list[int], want: int) -> list[tuple[Fraction, int]]:
    """The largest positive roots with their multiplicities, falling, until ``want``
    are counted; each within 2^-ROOT_BITS of its size."""
    positive = roots_above(f, 0, 0)
    top = -f[-2]  # the sum of all roots
    todo, out, have = [(0, top, 0, positive, 0)] if positive else [], [], 0
    while todo and have < want:
        lo, hi, s, above_lo, above_hi = todo.pop()  # the roots in (lo, hi] / 2^s
        n = above_lo - above_hi
        if hi - lo < 2 or lo.bit_length() <= ROOT_BITS:  # room for halving
            lo, hi, s = lo << 8, hi << 8, s + 8
        if lo and (hi - lo) << ROOT_BITS <= lo:
            out.append((Fraction(lo + hi, 2 << s), n))
            have += n
            continue
        mid = (lo + hi) // 2
        if n == 1 and (side := sign_at(f, mid, s)):
            above_mid = above_hi + (side != (-1) ** above_hi)
        elif n == 1:
            out.append((Fraction(mid, 1 << s), 1))
            have += 1
            continue
        else:
            above_mid = roots_above(f, mid, s)
        if above_lo > above_mid:
            todo.append((lo, mid, s, above_lo, above_mid))
        if above_mid > above_hi:
            todo.append((mid, hi, s, above_mid, above_hi))
    return out


def _fixed(x: Fraction) -> int:
    return (x.numerator << FIXED) // x.denominator


def null_vectors(matrix: list[list[int]], root: Fraction, count: int, rounds: int = 4) -> list[list[float]]:
    """``count`` orthonormal vectors that ``matrix`` less ``root`` takes to zero."""
    d = len(matrix)
    unit = max(sum(matrix[i][i] for i in range(d)), 1)
    a = np.array([[(x << FIXED) // unit for x in row] for row in matrix], dtype=object)
    mu = _fixed(root / unit)
    for i in range(d):
        a[i, i] -= mu
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] << FIXED) // a[k, k]
            a[k + 1 :, k + 1 :] -= (a[k + 1 :, k : k + 1] * a[k : k + 1, k + 1 :]) >> FIXED
    one = 1 << FIXED
    v = np.array([[one + (((i + 1) * (j + 2) * 2654435761) % 1000003 << (FIXED - 20)) for j in range(count)] for i in range(d)], dtype=object)
    for _ in range(rounds):
        v = v[order]
        for k in range(d - 1):
            v[k + 1 :] -= (a[k + 1 :, k : k + 1] * v[k : k + 1]) >> FIXED
        for k in range(d - 1, -1, -1):
            v[k] = np.array([(x << FIXED) // a[k, k] for x in v[k]], dtype=object)
            v[:k] -= (a[:k, k : k + 1] * v[k : k + 1]) >> FIXED
        for j in range(count):
            for _ in range(2):  # a second pass takes out what rounding left
                high = max(abs(x) for x in v[:, j]) or 1
                v[:, j] = np.array([(x << FIXED) // high for x in v[:, j]], dtype=object)
                for i in range(j):
                    v[:, j] -= (v[:, i] * (int((v[:, i] * v[:, j]).sum()) >> FIXED)) >> FIXED
            length = isqrt(int((v[:, j] * v[:, j]).sum())) or 1
            v[:, j] = np.array([(x << FIXED) // length for x in v[:, j]], dtype=object)
    return [[float(Fraction(int(x), one)) for x in v[:, j]] for j in range(count)]


def components(spark: SparkSession, scatter: list[list[int]], most: int) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue of the scatter, unit vector) by falling eigenvalue, up to ``most``
    of those above zero."""
    found = largest_roots(characteristic_polynomial(spark, scatter), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, top, bottom, n in zip(*[b.column(c).to_pylist() for c in ("k", "top", "bottom", "n")]):
                vectors = null_vectors(scatter, Fraction(int(top), int(bottom)), n)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(vectors, pa.list_(pa.float64()))], ["k", "i", "v"])

    if not found:
        return []
    tasks = spark.createDataFrame([(k, str(r.numerator), str(r.denominator), n) for k, (r, n) in enumerate(found)], "k int, top string, bottom string, n int")
    vectors = {(r.k, r.i): list(r.v) for r in tasks.mapInArrow(run, "k int, i int, v array<double>").collect()}
    return [(root, vectors[k, i]) for k, (root, n) in enumerate(found) for i in range(n)][:most]


def deviation_parts(y: np.ndarray, n: int, sums: list[int]) -> list[list[int] | np.ndarray]:
    """sum((n y - sums)^2) of each row as a 2^62 + b 2^32 + c 2^31 + e."""
    low = (1 << 31) - 1
    reach = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
    if reach < 1 << 56:
        a = n * y - np.array(sums, dtype=np.int64)
        hi, lo = a >> 31, a & low
        square = lo * lo
        return [(hi * hi).sum(axis=1), (hi * lo).sum(axis=1), (square >> 31).sum(axis=1), (square & low).sum(axis=1)]
    totals = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in y.tolist()]
    fit = [t if t < 1 << 124 else None for t in totals]  # more is no decimal of 38 digits
    part = lambda g: [None if t is None else g(t) for t in fit]
    return [part(lambda t: t >> 62), part(lambda t: 0), part(lambda t: (t >> 31) & low), part(lambda t: t & low)]


def whiten(embeddings: DataFrame, most: int = 8) -> DataFrame:
    """One row per vector that counts and component: (vec_id, component, n,
    deviation, whitened, explained, identity_error, eigenvalue).

    ``component`` counts from 1 by falling eigenvalue of the covariance of x;
    ``deviation`` is the exact sum of (n x - S)^2 as decimal(38, 0), null beyond 2^124;
    ``identity_error`` is measured on the whitened values of all rows.
    """
    spark = embeddings.sparkSession
    vec_id = embeddings.schema["vec_id"].dataType.simpleString()
    rows, dim = clean(embeddings)
    found: list[tuple[Fraction, list[float]]] = []
    if dim:
        n, sums, products = scatter_sums(rows, dim)
        scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
        trace = sum(scatter[i][i] for i in range(dim))
        found = components(spark, scatter, most)
    out = f"vec_id {vec_id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, eigenvalue double"
    if not found:
        return spark.createDataFrame([], out)
    values = [root / (n * n) for root, _ in found]
    weights = np.array([v for _, v in found]).T / np.array([sqrt(e) for e in values])
    mean = np.array([float(Fraction(s, n)) for s in sums])
    width = len(found)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(width), np.zeros((width, width))
        for b in batches:
            w = (whole(b, dim) - mean) @ weights
            first += w.sum(axis=0)
            second += w.T @ w
        cells = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "v"])

    total = np.zeros(width + width * width)
    for r in rows.mapInArrow(moments, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        total[r.cell] = r.v / n
    covariance = total[width:].reshape(width, width) - np.outer(total[:width], total[:width])
    error = float(np.abs(covariance - np.eye(width)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = whole(b, dim)
            w = (y - mean) @ weights
            at = pa.array(np.repeat(np.arange(len(y)), width))
            parts = [pa.array(p, pa.int64()).take(at) for p in deviation_parts(y, n, sums)]
            number = pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(y)))
            yield pa.RecordBatch.from_arrays([pc.take(b.column("vec_id"), at), number, *parts, pa.array(w.ravel())], ["vec_id", "component", "a", "b", "c", "e", "whitened"])

    big = lambda c, power: F.col(c).cast("decimal(20,0)") * F.lit(1 << power).cast("decimal(20,0)")
    exact = (big("a", 62) + big("b", 32) + big("c", 31) + F.col("e").cast("decimal(20,0)")).cast("decimal(38,0)")
    each = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col("component"))
    projected = rows.mapInArrow(project, f"vec_id {vec_id}, component int, a long, b long, c long, e long, whitened double")
    return projected.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), exact.alias("deviation"), "whitened",
        each([root / trace for root, _ in found]).alias("explained"), F.lit(error).alias("identity_error"), each(values).alias("eigenvalue"),
    )
