"""Vectors: normalising, quantising, exact neighbours, query search, centroids, diversity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scale import cut_lineage, kept, top_k


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalise(v) -> Column:
    """Unit vector; a zero vector stays zero.  The norm is taken once per vector:
    inside the inner function it would be taken again for every entry."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))[0]


def quantise(v) -> Column:
    """struct(scale, q): signed bytes with scale = max/127, 1 for a zero vector."""
    peak = F.array_max(F.transform(v, lambda x: F.abs(x)))
    scale = F.when(peak == 0, F.lit(1.0)).otherwise(peak / 127)
    return F.transform(F.array(scale), lambda s: F.struct(s.alias("scale"), F.transform(v, lambda x: F.floor(x / s + 0.5).cast("tinyint")).alias("q")))[0]


def dequantise(s: str) -> Column:
    return F.transform(F.col(s)["q"], lambda q: q.cast("double") * F.col(s)["scale"])


# --- exact neighbours -----------------------------------------------------------
PIVOT_BYTES = 64 << 20  # of all pivots together, which every task holds


class PivotTree:
    """Two levels of pivots: about sqrt(n) leaves under about n^(1/4) tops.

    A vector goes to the nearest leaf under its nearest top.  ``radius`` is the
    largest angle between a leaf and its vectors, ``cover`` the one between a top
    and anything below it, so both levels rule out what lies too far.
    """

    def __init__(self, pivots: np.ndarray):
        m = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)
        self.tops = m[: int(np.ceil(np.sqrt(len(m))))]
        top = (m @ self.tops.T).argmax(1)
        order = np.argsort(top, kind="stable")
        self.leaves, top = m[order], top[order]
        self.cut = np.searchsorted(top, np.arange(len(self.tops) + 1))
        self.radius = np.full(len(m), -np.inf)
        self.cover = np.full(len(self.tops), -np.inf)

    def measured(self, radii: dict[int, float]) -> PivotTree:
        """Takes the radii of the leaves that hold vectors."""
        for leaf, r in radii.items():
            self.radius[leaf] = r
        for t, (lo, hi) in enumerate(zip(self.cut[:-1], self.cut[1:])):
            apart = np.arccos(np.clip(self.leaves[lo:hi] @ self.tops[t], -1, 1))
            self.cover[t] = np.max(apart + self.radius[lo:hi], initial=-np.inf)
        return self

    def grouped(self, counts: dict[int, int], block: int) -> PivotTree:
        """Groups of neighbouring leaves with about ``block`` vectors: ``first`` group of
        each leaf and the number of groups, ``parts``, over which a crowded one is dealt."""
        n = np.zeros(len(self.leaves), np.int64)
        for leaf, c in counts.items():
            n[leaf] = c
        self.parts = np.maximum(1, -(-n // block))
        self.first = np.zeros(len(n), np.int64)
        group = held = 0
        for leaf in range(len(n)):
            if held and (held + n[leaf] > block or self.parts[leaf] > 1):
                group, held = group + 1, 0
            self.first[leaf] = group
            if self.parts[leaf] > 1:
                group += self.parts[leaf]
            else:
                held += n[leaf]
        return self

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each vector and the angle to it."""
        leaf, angle = np.zeros(len(x), np.int32), np.zeros(len(x))
        top = (x @ self.tops.T).argmax(1)
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            c = x[rows] @ self.leaves[self.cut[t] : self.cut[t + 1]].T
            leaf[rows] = self.cut[t] + c.argmax(1)
            angle[rows] = np.arccos(np.clip(c.max(1), -1, 1))
        return leaf, angle

    def reach(self, x: np.ndarray, need: np.ndarray):
        """(rows, leaves) that may hold a vector of cosine ``need`` or more, one top at a time."""
        near = lambda angle, radius: np.cos(np.maximum(angle - radius, 0)) + 2e-6
        tops = near(np.arccos(np.clip(x @ self.tops.T, -1, 1)), self.cover) >= need[:, None]
        for t in np.flatnonzero(tops.any(0) & np.isfinite(self.cover)):
            rows, at = np.flatnonzero(tops[:, t]), slice(self.cut[t], self.cut[t + 1])
            ok = (near(np.arccos(np.clip(x[rows] @ self.leaves[at].T, -1, 1)), self.radius[at]) >= need[rows, None]) & np.isfinite(self.radius[at])
            r, c = np.nonzero(ok)
            yield rows[r], (self.cut[t] + c).astype(np.int32)


def pick_pivots(vecs: DataFrame, most: int) -> np.ndarray:
    """Pivots: the vectors with the lowest hashes of their ids, as many as ``PIVOT_BYTES`` allow at most."""
    rows = vecs.select("id", "vec").orderBy(F.xxhash64("id"), "id")
    dim = max(1, len(rows.first()["vec"]))
    rows = rows.limit(max(1, min(most, PIVOT_BYTES // (8 * dim)))).select("vec").collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.array(vecs.tolist(), dtype=np.float64)


def _cells(vecs: DataFrame, tree: PivotTree) -> DataFrame:
    """Add the leaf ``cell`` of every vector and the angle to it."""

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                pdf["cell"], pdf["angle"] = tree.assign(_matrix(pdf["vec"]))
                yield pdf[["id", "vec", "cell", "angle"]]

    return vecs.select("id", "vec").mapInPandas(assign, "id long, vec array<double>, cell int, angle double")


def _planted(base: DataFrame, pivots: int, block: int) -> tuple[DataFrame, PivotTree]:
    """The vectors with their group ``grp``, and the tree with its radii and groups: two numbers per leaf on the driver."""
    tree = PivotTree(pick_pivots(base, pivots))
    celled = cut_lineage(_cells(base, tree))
    leaves = celled.groupBy("cell").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    tree.measured({r.cell: r.r for r in leaves}).grouped({r.cell: r.n for r in leaves}, block)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                cell = pdf["cell"].to_numpy()
                pdf["grp"] = tree.first[cell] + pdf["part"].to_numpy() % tree.parts[cell]
                yield pdf[["id", "vec", "cell", "grp"]]

    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("part")
    return celled.select("id", "vec", "cell", part).mapInPandas(place, "id long, vec array<double>, cell int, grp int"), tree


def _group_size(n: int, block: int) -> int:
    """Vectors per group.  A vector is sent once per group, so groups grow with
    the table up to a bound that a task holds easily."""
    return min(max(block, n // 8), 8 * block)


def _meetings(members: DataFrame, tree: PivotTree) -> DataFrame:
    """(lo, hi): the pairs of groups of which one holds a vector that can reach the other."""

    def reach(batches):
        for pdf in batches:
            if len(pdf):
                grp, leaves = pdf["grp"].to_numpy(np.int64), len(tree.leaves)
                seen = [np.unique(grp[rows] * leaves + leaf) for rows, leaf in tree.reach(_matrix(pdf["vec"]), pdf["need"].to_numpy())]
                seen = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
                own, leaf = seen // leaves, seen % leaves
                more = tree.parts[leaf]
                own, to = np.repeat(own, more), np.repeat(tree.first[leaf], more) + _counted(more)
                yield pd.DataFrame({"lo": np.minimum(own, to), "hi": np.maximum(own, to)}).drop_duplicates().astype("int32")

    return members.select("vec", "grp", "need").mapInPandas(reach, "lo int, hi int").distinct()


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _met(members: DataFrame, meetings: DataFrame) -> DataFrame:
    """``members`` once for every meeting of their group."""
    first = members.join(meetings.withColumn("grp", F.col("lo")), "grp")
    return first.unionByName(members.join(meetings.filter("lo < hi").withColumn("grp", F.col("hi")), "grp"))


SCORES = 1 << 22  # held at once by a task


def _scored(x: np.ndarray, y: np.ndarray):
    """(at, scores) of some rows of ``x`` with all of ``y``, ``SCORES`` numbers at a time."""
    step = max(1, SCORES // max(1, len(y)))
    for at in range(0, len(x), step):
        yield at, x[at : at + step] @ y.T


def _block_top(k: int, floor: float):
    """Best ``k`` of one block of data rows for one block of query rows."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x = np.array(left["vec"].tolist(), dtype=np.float64)
            y = np.array(right["vec"].tolist(), dtype=np.float64)
            xi, yi = left["id"].to_numpy(), right["id"].to_numpy()
            for at in range(0, len(x), 1024):
                s = np.round(x[at : at + 1024] @ y.T, 6)
                s[xi[at : at + 1024, None] == yi[None, :]] = -9
                order = np.lexsort((np.broadcast_to(yi, s.shape), -s), axis=1)[:, :k] if s.shape[1] <= 4 * k else _head(s, yi, k)
                rows = np.repeat(np.arange(len(s)), order.shape[1])
                cols = order.reshape(-1)
                score = s[rows, cols]
                keep = score >= floor
                out.append(pd.DataFrame({"id": xi[at + rows[keep]], "other": yi[cols[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "score": []}).astype({"id": "int64", "other": "int64", "score": "float64"})

    return best


def _head(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores per row, ties by the smaller id.  Scores of
    six digits and ranks of ids make one whole number, so no two are equal."""
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    key = rank[None, :] - (np.rint(s * 1e6).astype(np.int64) << 32)
    best = np.argpartition(key, k - 1, axis=1)[:, :k]
    return np.take_along_axis(best, np.take_along_axis(key, best, axis=1).argsort(axis=1), axis=1)


def _nearest(tree: PivotTree, k: int, floor: float, left: pd.DataFrame, right: pd.DataFrame):
    """Best ``k`` rows of ``right`` for every row of ``left`` that score at least its ``need``.

    Rows of one leaf come together, and a run of them meets the leaves that one
    of its rows can reach.  The k-th best of a first few columns raises the
    need, so that few scores are left to sort.
    """
    left, right = left.sort_values("cell"), right.sort_values("cell")
    x, y = _matrix(left["vec"]), _matrix(right["vec"])
    xi, yi, cells, need = left["id"].to_numpy(), right["id"].to_numpy(), right["cell"].to_numpy(), left["need"].to_numpy()
    shared = len(np.intersect1d(xi, yi)) > 0
    run = max(1, SCORES // max(1, len(y)))
    for lo in range(0, len(x), run):
        near = np.zeros(len(tree.leaves), bool)
        for _, leaf in tree.reach(x[lo : lo + run], need[lo : lo + run]):
            near[leaf] = True
        cols = np.flatnonzero(near[cells])
        if not len(cols):
            continue
        ids = yi[cols]
        s = x[lo : lo + run] @ y[cols].T
        mine = xi[lo : lo + run]
        if shared:
            s[mine[:, None] == ids[None, :]] = -9
        least = np.maximum(need[lo : lo + run], floor)
        if len(cols) > 8 * k:
            probe = s[:, :: max(1, len(cols) // (1024 + 4 * k))]
            if probe.shape[1] > k:
                least = np.maximum(least, np.partition(probe, probe.shape[1] - k, axis=1)[:, -k])
        ok = s >= least[:, None] - 2e-6
        if ok.sum() * 4 > s.size and len(cols) > 4 * k:  # ties without end
            s = np.round(s, 6)
            best = _head(s, ids, k)
            rows, at = np.repeat(np.arange(len(s)), best.shape[1]), best.reshape(-1)
            score = s[rows, at]
        else:
            rows, at = np.nonzero(ok)
            score = np.round(s[rows, at], 6)
            order = np.lexsort((ids[at], -score, rows))
            rows, at, score = rows[order], at[order], score[order]
            head = _counted(np.bincount(rows, minlength=len(s))) < k
            rows, at, score = rows[head], at[head], score[head]
        keep = score >= floor
        yield pd.DataFrame({"id": mine[rows[keep]], "other": ids[at[keep]], "score": score[keep]})


_FOUND = "id long, other long, score double"


def knn(vecs: DataFrame, k: int, floor: float = -1.0, block: int = 4096, pivots: int | None = None) -> DataFrame:
    """Exact ``k`` nearest by cosine for every unit vector: (id, other, score, rank).

    Vectors fall into the leaves of a pivot tree, sqrt(n) of them unless
    ``pivots`` says otherwise, and neighbouring leaves into groups of a bounded
    number of vectors; a crowded leaf is several groups.  First every vector
    searches its own group; the score of its k-th best then rules out each top
    and leaf that the triangle inequality on angles puts out of reach.  Two
    groups meet in one task if a vector of one can reach the other, so a vector
    is sent once per group at most.  Nothing is approximated.
    """
    base = cut_lineage(vecs.select("id", "vec"))
    n = base.count()
    if n <= block:  # one block holds everything: no cells needed
        one = base.withColumn("b", F.lit(0))
        slices = max(1, min(8, n // 256))
        q = base.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
        d = one.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        found = q.groupBy("b").cogroup(d.groupBy("b")).applyInPandas(_block_top(k, floor), _FOUND)
    else:
        members, tree = _planted(base, pivots or int(np.ceil(np.sqrt(n))), _group_size(n, block))
        none = pd.DataFrame({"id": [], "other": [], "score": []}).astype({"id": "int64", "other": "int64"})

        def inside(pdf):
            return pd.concat([none, *_nearest(tree, k, floor, pdf, pdf)])

        def between(pdf):
            a, b = pdf[pdf["grp"] == pdf["lo"]], pdf[pdf["grp"] == pdf["hi"]]
            return pd.concat([none, *_nearest(tree, k, floor, a, b), *_nearest(tree, k, floor, b, a)])

        members = cut_lineage(members)
        own = cut_lineage(top_k(members.withColumn("need", F.lit(float(floor))).groupBy("grp").applyInPandas(inside, _FOUND), ["id"], [F.desc("score"), "other"], k, "rank"))
        kth = own.filter(F.col("rank") == k).select("id", F.col("score").alias("kth"))
        needy = kept(members.join(kth, "id", "left").select("id", "vec", "cell", "grp", F.greatest(F.coalesce("kth", F.lit(-2.0)), F.lit(float(floor))).alias("need")), "members")
        meetings = kept(_meetings(needy, tree).filter("lo < hi"), "meetings")
        found = own.select("id", "other", "score").unionByName(_met(needy, meetings).groupBy("lo", "hi").applyInPandas(between, _FOUND))
    ranked = top_k(found, ["id"], [F.desc("score"), "other"], k, "rank")
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def best_match(left: DataFrame, right: DataFrame, block: int = 4096) -> DataFrame:
    """(id, other, score): the nearest right row with an equal ``key``, ties by id.

    Both sides are cut into blocks of about ``block`` rows per key, so a
    crowded key is a grid of tasks.
    """
    def blocks(df):
        return df.groupBy("key").agg((F.floor(F.count(F.lit(1)) / block) + 1).cast("int").alias("_n"))

    nl, nr = blocks(left).withColumnRenamed("_n", "_l"), blocks(right).withColumnRenamed("_n", "_r")
    grid = nl.join(nr, "key")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    a = left.select("id", "vec", "key").join(grid, "key").select(F.col("id").alias("id"), F.col("vec").alias("vec"), F.to_json(F.struct("key")).alias("k"), own("_l").alias("i"), spread("_r").alias("j"))
    b = right.select("id", "vec", "key").join(grid, "key").select(F.col("id").alias("id"), F.col("vec").alias("vec"), F.to_json(F.struct("key")).alias("k"), spread("_l").alias("i"), own("_r").alias("j"))
    hit = a.groupBy("k", "i", "j").cogroup(b.groupBy("k", "i", "j")).applyInPandas(_block_top(1, -1.0), "id long, other long, score double")
    return hit.groupBy("id").agg(F.min_by(F.struct("other", "score"), F.struct(-F.col("score"), F.col("other"))).alias("b")).select("id", "b.other", "b.score")


def reverse_neighbours(knn_table: DataFrame, k: int) -> DataFrame:
    """Who has me among their first ``k``."""
    return knn_table.filter(F.col("rank") <= k).select(F.col("other").alias("id"), F.col("id").alias("other"), "score")


def mutual_pairs(knn_table: DataFrame) -> DataFrame:
    """(a < b, score) where each is in the other's list."""
    swapped = knn_table.select(F.col("other").alias("id"), F.col("id").alias("other"))
    both = knn_table.filter("id < other").join(swapped, ["id", "other"], "left_semi")
    return both.select(F.col("id").alias("a"), F.col("other").alias("b"), "score")


def similar_pairs(vecs: DataFrame, floor: float, block: int = 2048, pivots: int | None = None) -> DataFrame:
    """All pairs (a < b) of a subset with cosine at or above ``floor``: groups of
    leaves of a pivot tree meet if one can hold a partner of the other."""
    base = cut_lineage(vecs.select("id", "vec"))
    n = base.count()
    if not n:
        return base.sparkSession.createDataFrame([], "a long, b long, score double")
    members, tree = _planted(base, pivots or (1 if n <= block else int(np.ceil(np.sqrt(n)))), _group_size(n, block))
    members = kept(members.withColumn("need", F.lit(float(floor))), "members")
    meetings = kept(_meetings(members, tree), "meetings")

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        l, r = pdf[pdf["grp"] == pdf["lo"]], pdf[pdf["grp"] == pdf["hi"]]
        li, ri = l["id"].to_numpy(), r["id"].to_numpy()
        out = [pd.DataFrame({"a": [], "b": [], "score": []}).astype({"a": "int64", "b": "int64"})]
        if len(l) and len(r):
            twice = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]  # a group with itself shows every pair from both ends
            for at, s in _scored(_matrix(l["vec"]), _matrix(r["vec"])):
                i, j = np.nonzero(s >= floor - 1e-6)
                score = np.round(s[i, j], 6)
                ok = (score >= floor) & ((li[at + i] < ri[j]) if twice else (li[at + i] != ri[j]))
                a, b = li[at + i[ok]], ri[j[ok]]
                out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score[ok]}))
        return pd.concat(out)

    return _met(members, meetings).groupBy("lo", "hi").applyInPandas(close, "a long, b long, score double")


# --- query search ---------------------------------------------------------------
def query_top(queries: DataFrame, vecs: DataFrame, k: int, part: Sequence[str] = (), most_queries: int = 10000) -> DataFrame:
    """Best ``k`` rows per query (and per column of ``part``) by one scan.

    The query table is counted and goes to every task as one matrix; more
    than ``most_queries`` are answered in several scans.
    """
    total = queries.count()
    turns = max(1, -(-total // most_queries))
    out = None
    for t in range(turns):
        some = queries if turns == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(turns)) == t)
        rows = some.select("qid", "vec").collect()
        if not rows:
            continue
        qid = np.array([r[0] for r in rows], dtype=np.int64)
        q = np.array([r[1] for r in rows], dtype=np.float64)

        def scan(batches, qid=qid, q=q):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.array(pdf["vec"].tolist(), dtype=np.float64)
                tags = pdf[list(part)].astype(str).agg("|".join, axis=1).to_numpy() if part else np.zeros(len(pdf))
                ids = pdf["id"].to_numpy()
                for tag in np.unique(tags):
                    at = np.flatnonzero(tags == tag)
                    s = np.round(q @ x[at].T, 6)
                    order = _head(s, ids[at], min(k, len(at)))
                    r = np.repeat(np.arange(len(q)), order.shape[1])
                    c = at[order.reshape(-1)]
                    frame = {"qid": qid[r], "id": ids[c], "score": s[r, order.reshape(-1)]}
                    frame.update({p: pdf[p].to_numpy()[c] for p in part})
                    yield pd.DataFrame(frame)

        kinds = "".join(f", {p} {vecs.schema[p].dataType.simpleString()}" for p in part)
        hits = vecs.select("id", "vec", *part).mapInPandas(scan, "qid long, id long, score double" + kinds)
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, ["qid", *part], [F.desc("score"), "id"], k, "rank").withColumn("rank", F.col("rank").cast("long"))


def multi_source_top(queries: DataFrame, vecs: DataFrame, source: str, n_sources: int, k: int) -> DataFrame:
    """A quota of hits from every source, merged, then the best ``k``."""
    quota = max(3, -(-k // max(1, n_sources)) + 1)
    per = query_top(queries, vecs, quota, [source]).drop("rank")
    return top_k(per, ["qid"], [F.desc("score"), source, "id"], k)


# --- centroids --------------------------------------------------------------------
def vector_sums(vecs: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Component sums per group as (by, n, sum): partial sums per dimension, no list of vectors."""
    w = F.lit(1.0) if weight is None else weight
    dims = vecs.select(*by, w.alias("_w"), F.posexplode("vec").alias("_d", "_x"))
    sums = dims.groupBy(*by, "_d").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_d", "_s"))), lambda s: s["_s"]).alias("sum"))


def whole_sums(members: DataFrame, vecs: DataFrame, by: str, most: int = 256) -> DataFrame:
    """(by, sum) of the vectors of (by, id), like ``vector_sums``, for groups of few
    vectors: a vector is sent whole, not as a row per component.  A group is dealt
    by hash of the id over as many parts as keep a list at about ``most`` vectors."""
    size = members.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts")).filter("_parts > 1")
    part = F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1))).alias("_part")
    dealt = members.join(size, by, "left").select(by, "id", part).join(vecs.select("id", "vec"), "id")
    added = lambda c: F.aggregate(F.slice(c, 2, F.size(c)), F.element_at(c, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    some = dealt.groupBy(by, "_part").agg(F.collect_list("vec").alias("_v")).select(by, added(F.col("_v")).alias("_s"))
    return some.groupBy(by).agg(F.collect_list("_s").alias("_v")).select(by, added(F.col("_v")).alias("sum"))


def centroids(vecs: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    return vector_sums(vecs, by, weight).select(*by, "n", normalise("sum").alias("centroid"))


def proximity(vecs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Cosine of every vector to the centroid of the seed rows."""
    c = centroids(seeds.withColumn("_g", F.lit(0)), ["_g"]).select("centroid")
    return vecs.withColumn("_c", c.scalar()).withColumn("prox", F.round(dot("vec", "_c"), 6)).drop("_c")


def generality(vecs: DataFrame) -> DataFrame:
    """Mean cosine to all other vectors, from the sum vector alone."""
    s = vector_sums(vecs.withColumn("_g", F.lit(0)), ["_g"])
    stat = s.agg(F.first(F.struct("n", "sum")))
    out = vecs.withColumn("_s", stat.scalar())
    return out.withColumn("generality", (dot("vec", F.col("_s.sum")) - dot("vec", "vec")) / (F.col("_s.n") - 1)).drop("_s")


def background(knn_table: DataFrame, low: int = 21, high: int = 35, dense: int = 20) -> DataFrame:
    """Mean score just outside the near ranks, and of the near ranks."""
    return knn_table.groupBy("id").agg(
        F.avg(F.when(F.col("rank").between(low, high), F.col("score"))).alias("back"), F.avg(F.when(F.col("rank") <= dense, F.col("score"))).alias("density")
    )


def surprise_pairs(knn_table: DataFrame, back: DataFrame, place: DataFrame, near_dup: float = 0.95, adjacent: int = 2, k: int = 40) -> DataFrame:
    """(a, b, cos, s, f): score above both backgrounds, saturated by its median."""
    from corpusloom.operators.stats import index_quantiles

    und = knn_table.filter(F.col("rank") <= k).groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("score").alias("cos"))
    for side in ("a", "b"):
        und = und.join(place.select(F.col("id").alias(side), F.col("grp").alias(f"_g{side}"), F.col("pos").alias(f"_p{side}")), side)
        und = und.join(back.select(F.col("id").alias(side), F.col("back").alias(f"_b{side}")), side)
    keep = und.filter((F.col("cos") < near_dup) & ~((F.col("_ga") == F.col("_gb")) & (F.abs(F.col("_pa") - F.col("_pb")) <= adjacent)))
    s = keep.withColumn("s", F.round(F.col("cos") - (F.col("_ba") + F.col("_bb")) / 2, 8)).filter("s > 0").select("a", "b", "cos", "s")
    s = cut_lineage(s)
    # the reference position is floor(n/2): one past the lower middle
    n = s.count()
    med = index_quantiles(s, "s", [min(1.0, (n // 2 + 1e-9) / max(1, n - 1))]).select("value")
    return s.withColumn("_m", F.coalesce(med.scalar(), F.lit(1e-6))).withColumn("f", F.col("s") / (F.col("s") + F.col("_m"))).drop("_m")


def cluster_summary(members: DataFrame, cents: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """Representative, cohesion, size and most linked member of each cluster."""
    d = members.join(cents.select("cluster", "centroid"), "cluster").withColumn("sim", F.round(dot("vec", "centroid"), 6))
    d = d.join(degree, "id", "left") if degree is not None else d.withColumn("degree", F.lit(0))
    d = d.withColumn("degree", F.coalesce("degree", F.lit(0)))
    return d.groupBy("cluster").agg(
        F.min_by("id", F.struct(-F.col("sim"), F.col("id"))).alias("rep"),
        F.round(F.avg("sim"), 3).alias("cohesion"),
        F.count(F.lit(1)).alias("size"),
        F.min_by("id", F.struct(-F.col("degree"), F.col("id"))).alias("mother"),
    )


def nearest_centroid(vecs: DataFrame, cents: DataFrame, floor: float, most: int = 20000) -> DataFrame:
    """(id, cluster, sim): the nearest centroid at or above ``floor``, else null.

    The centroid table is counted before it is shipped to the tasks; a larger
    one is searched block by block instead.
    """
    rows = cents.select("cluster", "centroid").limit(most + 1).collect()
    if len(rows) > most:
        left = vecs.select("id", "vec").withColumn("key", F.lit(0))
        right = cents.select(F.col("cluster").alias("id"), F.col("centroid").alias("vec")).withColumn("key", F.lit(0))
        best = best_match(left, right)
        return best.select("id", F.when(F.col("score") >= floor, F.col("other")).alias("cluster"), F.col("score").alias("sim"))
    names = np.array([r[0] for r in rows])
    order = np.argsort(names, kind="stable")
    names, m = names[order], np.array([rows[i][1] for i in order], dtype=np.float64)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                s = np.round(np.array(pdf["vec"].tolist(), dtype=np.float64) @ m.T, 6)
                at = s.argmax(1)
                sim = s[np.arange(len(s)), at]
                yield pd.DataFrame({"id": pdf["id"], "cluster": [int(c) if v >= floor else None for c, v in zip(names[at], sim)], "sim": sim}).astype({"cluster": "Int64"})

    return vecs.select("id", "vec").mapInPandas(assign, "id long, cluster long, sim double")


def relevance_gate(hits: DataFrame, prior: DataFrame, k: int, band: float = 0.15, floor: float = 0.5, enough: int = 5, fallback: int = 6) -> DataFrame:
    """Hits close to the best and above a floor, or the first few; re-ranked with a small prior."""
    w = Window.partitionBy("qid")
    g = hits.withColumn("_top", F.max("score").over(w)).withColumn("_ok", (F.col("score") >= F.round(F.col("_top") - band, 6)) & (F.col("score") >= floor))
    g = g.withColumn("_n", F.count(F.when(F.col("_ok"), 1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "id")))
    pool = g.filter(F.when(F.col("_n") >= enough, F.col("_ok")).otherwise(F.col("_r") <= fallback))
    scored = pool.join(prior, "id", "left").withColumn("final", F.round(F.col("score") + 0.1 * F.coalesce("prior", F.lit(0.0)), 6))
    return top_k(scored, ["qid"], [F.desc("final"), "id"], k).select("qid", "id", "score", "final")


def hybrid_thread(lexical: DataFrame, keyed: DataFrame, semantic: DataFrame, window: int = 24, most: int = 16, band: float = 0.10) -> DataFrame:
    """(qid, id, src): word hits, then key hits, then a semantic halo cut at its largest drop."""
    solid = lexical.select("qid", "id", F.lit(0).alias("o")).unionByName(keyed.select("qid", "id", F.lit(1).alias("o"))).groupBy("qid", "id").agg(F.min("o").alias("o"))
    best = semantic.groupBy("qid").agg(F.max("score").alias("top"))
    fresh = top_k(semantic.join(solid, ["qid", "id"], "left_anti"), ["qid"], [F.desc("score"), "id"], window, "r")
    nxt = fresh.select("qid", (F.col("r") - 1).alias("r"), F.col("score").alias("next"))
    drops = fresh.join(nxt, ["qid", "r"], "left").withColumn("drop", F.round(F.col("score") - F.col("next"), 6))
    # the first largest drop decides; no drop at all keeps the whole window
    cut = drops.groupBy("qid").agg(F.min_by("r", F.when(F.col("drop") > 0, F.struct(-F.col("drop"), F.col("r")))).alias("cut"), F.max("r").alias("n"))
    halo = fresh.join(cut, "qid").join(best, "qid").filter((F.col("r") <= F.least(F.coalesce("cut", "n"), F.lit(most))) & (F.col("score") >= F.round(F.col("top") - band, 6)))
    every = solid.unionByName(halo.select("qid", "id", F.lit(2).alias("o")))
    return every.select("qid", "id", F.element_at(F.array(F.lit("lex"), F.lit("key"), F.lit("sem")), F.col("o") + 1).alias("src"))


# --- greedy choices inside one node's short edge list -------------------------------
def diversity_sum(edges: DataFrame, vecs: DataFrame, density: DataFrame, mean: float, most: int = 25) -> DataFrame:
    """(node, ds): edge weights discounted by the redundancy of each end with those picked before.

    ``edges`` has (node, other, w); the ``most`` strongest count, so a group
    handed to pandas has at most that many rows.
    """
    short = top_k(edges, ["node"], [F.desc("w"), "other"], most)
    full = short.join(vecs.select(F.col("id").alias("other"), "vec"), "other").join(density.select(F.col("id").alias("other"), "density"), "other")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "other"], ascending=[False, True])
        v = np.array(pdf["vec"].tolist(), dtype=np.float64)
        d, w = pdf["density"].to_numpy(), pdf["w"].to_numpy()
        gap = (d[:, None] + d[None, :]) / 2 - mean
        with np.errstate(divide="ignore", invalid="ignore"):
            red = np.where(gap <= 0, 1.0, np.clip((v @ v.T - mean) / gap, 0, 1))
        seen = np.array([red[i, :i].max() if i else 0.0 for i in range(len(w))])
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "ds": [float((w * (1 - seen)).sum())]})

    return full.select("node", "other", "w", "vec", "density").groupBy("node").applyInPandas(one, "node long, ds double")


def suppress_near_duplicates(items: DataFrame, vecs: DataFrame, limit: float, most: int = 25) -> DataFrame:
    """Per hub, best first, items (hub, id, w) not closer than ``limit`` to one kept before."""
    close = _close_within(items, vecs, limit)
    kept = greedy_independent(items.select("hub", "id", "w"), close)
    return top_k(kept, ["hub"], [F.desc("w"), "id"], most)


def _close_within(items: DataFrame, vecs: DataFrame, limit: float, block: int = 256) -> DataFrame:
    """(hub, a, b): close pairs of items of one hub.  Only such pairs are scored;
    a large hub is cut into blocks, and pairs of blocks meet by an equi-join."""
    i = items.select("hub", "id").distinct().join(vecs.select("id", "vec"), "id")
    size = items.groupBy("hub").agg(F.ceil(F.countDistinct("id") / block).cast("int").alias("_n"))
    i = i.join(size, "hub").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    left = i.select("hub", F.col("id").alias("a"), F.col("vec").alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o"), F.col("_b").alias("_i"))
    left = left.withColumn("_lo", F.least("_i", "_o")).withColumn("_hi", F.greatest("_i", "_o"))
    right = i.select("hub", F.col("id").alias("b"), F.col("vec").alias("_y"), F.col("_b").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o"))
    right = right.select("hub", "b", "_y", "_j", F.least("_j", "_o").alias("_lo"), F.greatest("_j", "_o").alias("_hi"))
    pair = left.join(right, ["hub", "_lo", "_hi"]).filter((F.col("a") < F.col("b")) & ((F.col("_lo") == F.col("_hi")) | (F.col("_i") != F.col("_j"))))
    return pair.filter(F.round(dot("_x", "_y"), 6) > limit).select("hub", "a", "b").distinct()


def greedy_independent(items: DataFrame, conflicts: DataFrame, together: int = 100_000) -> DataFrame:
    """Greedy choice by (w desc, id) without two conflicting items, equal to the
    one-by-one walk.

    Conflicts reach no further than their connected component, so a component of
    up to ``together`` conflicts is walked in one task, however long its chains
    are.  A larger one is settled in rounds: an item is kept once no better
    undecided rival is left and dropped when a rival is kept.
    """
    from corpusloom.operators.graph import components

    name = lambda c: F.xxhash64("hub", c)  # noqa: E731 - a collision only joins two components
    edges = cut_lineage(conflicts.select("hub", "a", "b").distinct())
    if edges.isEmpty():
        return items
    comp = components(edges.select(name("a").alias("src"), name("b").alias("dst")))
    edges = edges.join(comp.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("_n") == name("a")).drop("_n")
    size = edges.groupBy("_c").agg(F.count(F.lit(1)).alias("n"))
    placed = cut_lineage(items.join(comp.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("_n") == name("id"), "left").drop("_n").join(size, "_c", "left"))
    edges = cut_lineage(edges.join(size, "_c"))
    schema = items.schema.simpleString()[7:-1]
    order = items.columns

    def walk(mine: pd.DataFrame, their: pd.DataFrame) -> pd.DataFrame:
        rivals: dict[tuple, list] = {}
        for hub, a, b in zip(their["hub"], their["a"], their["b"]):
            rivals.setdefault((hub, a), []).append((hub, b))
            rivals.setdefault((hub, b), []).append((hub, a))
        mine = mine.sort_values(["w", "id"], ascending=[False, True])
        lost, keep = set(), []
        for key in zip(mine["hub"], mine["id"]):
            keep.append(key not in lost)
            if keep[-1]:
                lost.update(rivals.get(key, ()))
        return mine[keep][order]

    few = F.col("n") <= together
    walked = placed.filter(few).groupBy("_c").cogroup(edges.filter(few).select(F.col("_c").alias("_d"), "hub", "a", "b").groupBy("_d")).applyInPandas(walk, schema)
    kept = placed.filter("n IS NULL").select(*order).unionByName(walked)
    if size.filter(~few).isEmpty():
        return kept
    return kept.unionByName(_greedy_rounds(placed.filter(~few).select(*order), edges.filter(~few)))


def _greedy_rounds(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    both = conflicts.select("hub", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("rival")), F.struct(F.col("b").alias("id"), F.col("a").alias("rival")))).alias("x")).select("hub", "x.*").distinct()
    open_ = cut_lineage(items)
    kept = None
    while True:  # the best open item of every hub is settled in each round
        rank = lambda c: F.struct(-F.col(f"{c}w"), F.col(f"{c}id"))
        mine = open_.select("hub", "id", "w")
        rivals = open_.select("hub", F.col("id").alias("rival"), F.col("w").alias("rw"))
        beaten = mine.join(both, ["hub", "id"]).join(rivals, ["hub", "rival"])
        beaten = beaten.filter(F.struct(-F.col("rw"), F.col("rival")) < rank("")).select("hub", "id").distinct()
        win = cut_lineage(mine.join(beaten, ["hub", "id"], "left_anti"))
        kept = win if kept is None else kept.unionByName(win)
        lost = win.join(both, ["hub", "id"]).select("hub", F.col("rival").alias("id")).distinct()
        open_ = cut_lineage(mine.join(win, ["hub", "id"], "left_anti").join(lost, ["hub", "id"], "left_anti"))
        if open_.isEmpty():
            return kept
