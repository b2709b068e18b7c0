"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits.  The bits
are grouped into partitions, correlated bits together, and partition i gets a
threshold t_i with sum(t_i + 1) = radius + 1: two linked fingerprints differ
in at most t_i bits of some partition i.  Thresholds come from a dynamic
programme over estimated candidate counts.  A fingerprint stands in the bucket
of its own value of each partition and is sent to the buckets within t_i bits
of it; members of a bucket are verified over all 64 bits.

Equal fingerprints are folded before anything is compared.  A bucket of more
than ``block`` members is cut into blocks, one task row per pair of blocks, and
every row returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import null_safe_join
from corpusloom.llm.common import stored, text_key, text_of
from corpusloom.operators.graph import components

BITS = 64


def simhash(text: str, words_per_shingle: int = 4) -> int:
    """Bit i is set if it is set in more than half of the shingle hashes.

    Words are lower-cased in A-Z only; fewer words than a shingle make one
    shingle; no word gives 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.split() parts at space and 09-0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(words_per_shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return majority_bits(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], dtype="<u8"))


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint of the hashes of all shingles; 0 if there are none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo : lo + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, text_key, fp): one row per row of ``docs``; null text is empty."""
    rows = docs.select("doc_id", text_key().alias("text_key"), text_of().alias("text"))
    schema = rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, words_per_shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, schema)


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set, over all rows of ``fps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel().astype(np.int64))], ["i", "j", "n"])

    both = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = r.n
    return both


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width; each starts from the free bit of lowest
    number and takes the free bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [free.pop(0)]
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def allocate(groups: list[list[int]], sample: np.ndarray, n: int, radius: int) -> tuple[float, list[int]]:
    """Thresholds (-1: unused) of least estimated cost and that cost.

    A partition at threshold t costs its candidates, n^2 / 2 times the share of
    sampled pairs within t bits there, and the probes n * sum(C(width, i)).
    """
    pairs = sample[:, None] ^ sample[None, :]
    upper = np.triu_indices(len(sample), 1)
    costs = []
    for g in groups:
        mask = np.uint64(sum(1 << b for b in g))
        seen = np.bitwise_count(pairs & mask)[upper]
        probes = [sum(comb(len(g), i) for i in range(t + 1)) for t in range(radius + 1)]
        share = [((seen <= t).sum() + 1) / (len(seen) + 1) if len(seen) else 1.0 for t in range(radius + 1)]
        share = [max(s, probes[t] / 2.0 ** len(g)) for t, s in enumerate(share)]  # a sample can't show rare meetings
        costs.append([0.0] + [n * n / 2 * share[t] / 50 + n * probes[t] for t in range(radius + 1)])  # a probe weighs as much as 50 vectorised comparisons
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, plan) in best.items():
            for give in range(radius + 2 - used):
                cand = (cost + c[give], [*plan, give - 1])
                if used + give not in nxt or cand < nxt[used + give]:
                    nxt[used + give] = cand
        best = nxt
    return best[radius + 1]


def plan_partitions(fps: DataFrame, radius: int, sample_rows: int = 1500) -> list[tuple[int, int]]:
    """(mask, threshold) of the partitions used, for distinct fingerprints ``fps``.

    Only the cost estimate looks at a sample; any plan finds every link.
    """
    both = bit_statistics(fps)
    n = fps.count()
    sample = np.array([r.fp for r in fps.select("fp").orderBy(F.xxhash64("fp")).limit(sample_rows).collect()], dtype=np.int64).view(np.uint64)
    plans = []
    for parts in range(min(2, radius + 1), radius + 2):
        groups = group_bits(both, n, parts)
        cost, t = allocate(groups, sample, n, radius)
        plans.append((cost, [(sum(1 << b for b in g), k) for g, k in zip(groups, t) if k >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bucket_rows(fps: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """(part, value, fp, probe): own buckets and the buckets probed."""
    moves = []
    for part, (mask, t) in enumerate(plan):
        bits = [1 << b for b in range(BITS) if mask >> b & 1]
        for k in range(t + 1):
            moves += [(part, _signed(mask), _signed(sum(c))) for c in combinations(bits, k)]
    lit = [f"named_struct('part', {p}, 'mask', {m}L, 'flip', {f}L)".replace("-9223372036854775808L", "shiftleft(1L, 63)") for p, m, f in moves]
    rows = fps.select("fp", F.explode(F.expr(f"array({', '.join(lit)})")).alias("m"))
    return rows.select(F.col("m.part").alias("part"), F.expr("(fp & m.mask) ^ m.flip").alias("value"), "fp", (F.col("m.flip") != 0).alias("probe"))


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is connected by links between the two sides."""
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
    far = len(left)
    lab = np.arange(len(left))
    while True:
        over = np.where(near, lab[:, None], far).min(axis=0, initial=far)
        new = np.minimum(lab, np.where(near, over[None, :], far).min(axis=1, initial=far))
        if (new == lab).all():
            break
        lab = new[new] if far else new
    hit = over < far
    return np.concatenate([left[lab], left[over[hit]]]), np.concatenate([left, right[hit]])


def verified_links(batches: Iterator[pa.RecordBatch], radius: int, dense: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of two lists, ``own`` and ``others``: links between the first and
    everything in both.  Small rows are compared together, large ones apart."""
    for b in batches:
        own, others = b.column("own"), b.column("others")
        n_own, n_oth = (np.diff(c.offsets.to_numpy()) for c in (own, others))
        v_own, v_oth = (c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (own, others))
        s_own, s_oth = np.cumsum(n_own) - n_own, np.cumsum(n_oth) - n_oth
        src, dst = [], []
        work = n_own * (n_own + n_oth)
        for i in np.flatnonzero(work > dense):
            left, rest = v_own[s_own[i] : s_own[i] + n_own[i]], v_oth[s_oth[i] : s_oth[i] + n_oth[i]]
            a, z = _forest(left, np.concatenate([left, rest]), radius)
            src.append(a), dst.append(z)
        small = np.flatnonzero(work <= dense)
        for starts, n, values in ((s_own, n_own, v_own), (s_oth, n_oth, v_oth)):
            size = n_own[small] * n[small]
            for rows in np.split(small, np.flatnonzero(np.diff(np.cumsum(size) >> 21)) + 1):
                count = n_own[rows] * n[rows]
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                width = np.maximum(np.repeat(n[rows], count), 1)
                a = v_own[np.repeat(s_own[rows], count) + k // width]
                z = values[np.repeat(starts[rows], count) + k % width]
                ok = (np.bitwise_count(a ^ z) <= radius) & (a != z)
                src.append(a[ok]), dst.append(z[ok])
        a, z = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (src, dst))
        keep = a != z
        yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(z[keep].view(np.int64))], ["src", "dst"])


def links(fps: DataFrame, radius: int = 4, block: int = 1024) -> DataFrame:
    """(src, dst): links between distinct fingerprints, enough of them to
    connect whatever is connected at ``radius`` or fewer differing bits."""
    rows = bucket_rows(fps, plan_partitions(fps, radius))
    large = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large = large.select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(large, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # a task row (i, j) compares own fingerprints of block i with all of block j
    as_left = F.when(~F.col("probe"), F.transform(every, lambda j: F.struct(at.alias("i"), j.alias("j"), F.lit(True).alias("left")))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>"))
    as_right = F.when((F.col("blocks") > 1) | F.col("probe"), F.transform(every, lambda i: F.struct(i.alias("i"), at.alias("j"), F.lit(False).alias("left")))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>"))
    dealt = rows.select("part", "value", "fp", F.explode(F.concat(as_left, as_right)).alias("t"))
    lists = dealt.groupBy("part", "value", "t.i", "t.j").agg(
        F.collect_list(F.when(F.col("t.left"), F.col("fp"))).alias("own"), F.collect_list(F.when(~F.col("t.left"), F.col("fp"))).alias("others")
    )
    lists = lists.filter("size(own) > 0 AND size(own) + size(others) > 1").select("own", "others")
    return lists.mapInArrow(lambda it: verified_links(it, radius), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id, label), one row per row of ``docs``.

    ``label`` names the group by one of its fingerprints; ``component_id`` is the smallest doc_id reachable over links.  Texts
    without a word have fingerprint zero and link like any other; a null doc_id
    counts as larger than any other and is the component only of documents
    that reach none but null ids.  Rows that repeat an id are rows like any
    other.  An empty table gives an empty one.
    """
    marked = stored(fingerprints(docs, words_per_shingle), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    comp = components(stored(links(fps, radius), "links"))
    member = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))
    smallest = member.groupBy("label").agg(F.min("first").alias("component_id"))
    labelled = member.join(smallest, "label").select("fp", "component_id", "label")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(labelled, "fp").select("doc_id", "text_key", hexed, "component_id", "label")


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (null
    last), of those the one with the smallest key of its text; equal rows are
    one."""
    groups = near_duplicates(docs, words_per_shingle, radius)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    kept = groups.groupBy("label").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_key")
    keyed = docs.withColumn("_text_key", text_key())
    out = null_safe_join(keyed, kept.withColumnRenamed("text_key", "_text_key"), ["doc_id", "_text_key"], "left_semi")
    return out.dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
