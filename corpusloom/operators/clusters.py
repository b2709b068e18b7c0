"""Clusters of vectors: spherical k-means, two levels, sense splits, clean-up, disjoint fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import cut_lineage, top_k
from corpusloom.operators import vectors as v


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each id, the same in every run."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2.0**-54


def _pick(vecs: DataFrame, chosen: list, how: str, seed: int, weight: str | None) -> tuple[int, list[float]]:
    """The next start by one pass in which every task names its best vector.

    ``++`` draws with probability proportional to the distance from the starts
    so far: the least -log(u) / distance over all vectors, u by hash, is such a
    draw.  ``farthest`` takes the largest distance, ties by id.
    """
    c = np.array([x for _, x in chosen], dtype=np.float64)

    def best(batches):
        top = None
        for pdf in batches:
            if len(pdf):
                ids, x = pdf["id"].to_numpy(), np.array(pdf["vec"].tolist(), dtype=np.float64)
                d = np.maximum(np.round(1 - (x @ c.T).max(1), 9), 0) if len(c) else np.ones(len(x))
                mass = d * (pdf[weight].to_numpy() if weight else 1.0)
                with np.errstate(divide="ignore"):
                    key = -d if how == "farthest" and len(c) else np.where(mass > 0, -np.log(_uniform(ids, seed + len(chosen))) / mass, np.inf)
                i = np.lexsort((ids, key))[0]
                if top is None or (key[i], ids[i]) < top[:2]:
                    top = (float(key[i]), int(ids[i]), x[i].tolist())
        if top:
            yield pd.DataFrame({"key": [top[0]], "id": [top[1]], "vec": [top[2]]})

    columns = ["id", "vec", *([weight] if weight else [])]
    r = vecs.select(*columns).mapInPandas(best, "key double, id long, vec array<double>").orderBy("key", "id").first()
    return r["id"], list(r["vec"])


def starts(vecs: DataFrame, k: int, how: str = "++", seed: int = 17, weight: str | None = None) -> np.ndarray:
    """Up to ``k`` starting centroids: ``++``, ``farthest`` or ``shuffle`` (by hash of the id)."""
    if how == "shuffle":
        rows = vecs.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("vec").limit(k).collect()
        return np.array([r[0] for r in rows], dtype=np.float64)
    chosen: list = []
    for _ in range(min(k, vecs.count())):
        chosen.append(_pick(vecs, chosen, how, seed, weight))
    return np.array([x for _, x in chosen], dtype=np.float64)


def _place(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centroid, the first of equally near ones."""
    return np.round(x @ c.T, 9).argmax(1)


def spherical_kmeans(vecs: DataFrame, k: int, seed: int = 17, weight: str | None = None, rounds: int = 40, start: str | np.ndarray = "++", empty: str = "keep") -> tuple[DataFrame, DataFrame]:
    """(vecs, cluster) and (cluster, centroid) of cosine k-means on unit vectors.

    A round is one pass: each task sums its vectors per cluster, the sums of a
    cluster meet in Spark, and the driver gets ``k`` centroids and a checksum of
    the assignment, which ends the rounds once it repeats.  ``empty`` clusters
    ``keep`` their centroid, or ``farthest`` moves it to the vector farthest
    from all centroids.
    """
    base = cut_lineage(vecs)
    spark = vecs.sparkSession
    c = starts(base, k, start, seed, weight) if isinstance(start, str) else np.array(start, dtype=np.float64)
    columns = ["id", "vec", *([weight] if weight else [])]
    before = None
    for i in range(rounds):

        def sums(batches, c=c):
            total, mass, mark = np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c), np.uint64)
            for pdf in batches:
                if len(pdf):
                    x, w = np.array(pdf["vec"].tolist(), dtype=np.float64), pdf[weight].to_numpy(np.float64) if weight else np.ones(len(pdf))
                    at = _place(x, c)
                    np.add.at(total, at, x * w[:, None])
                    mass += np.bincount(at, weights=w, minlength=len(c))
                    np.add.at(mark, at, (_uniform(pdf["id"].to_numpy(), 1) * 2**40).astype(np.uint64))
            yield pd.DataFrame({"cluster": np.arange(len(c)), "total": list(total), "mass": mass, "mark": (mark & np.uint64((1 << 40) - 1)).astype(np.int64)})

        def meet(pdf):
            return pd.DataFrame({"cluster": pdf["cluster"].iloc[:1], "total": [np.sum(pdf["total"].tolist(), axis=0)], "mass": [pdf["mass"].sum()], "mark": [int(pdf["mark"].sum())]})

        kind = "cluster long, total array<double>, mass double, mark long"
        rows = sorted(base.select(*columns).mapInPandas(sums, kind).groupBy("cluster").applyInPandas(meet, kind).collect(), key=lambda r: r.cluster)
        c = c.copy()
        for r in rows:
            t = np.array(r.total)
            if r.mass and np.linalg.norm(t):
                c[r.cluster] = t / np.linalg.norm(t)
        gone = [r.cluster for r in rows if not r.mass]
        if empty == "farthest":
            for j in gone:
                live = [(None, x) for n, x in enumerate(c.tolist()) if n not in gone or n < j]
                c[j] = _pick(base, live, "farthest", seed, None)[1]
        marks = [(r.mark, r.mass) for r in rows]
        if marks == before:
            break
        before = marks
    schema = vecs.schema.simpleString()[7:-1] + ",cluster:bigint"

    def placed(batches, c=c):
        for pdf in batches:
            if len(pdf):
                pdf["cluster"] = _place(np.array(pdf["vec"].tolist(), dtype=np.float64), c)
                yield pdf

    cents = spark.createDataFrame([(i, x) for i, x in enumerate(c.tolist())], "cluster long, centroid array<double>")
    return base.mapInPandas(placed, schema), cents


def farthest_points(vecs: DataFrame, first: int, k: int) -> DataFrame:
    """(pick, seed): each next seed is the vector farthest from all seeds so far."""
    chosen = [(first, list(vecs.filter(F.col("id") == first).select("vec").first()[0]))]
    for _ in range(k - 1):
        chosen.append(_pick(vecs, chosen, "farthest", 0, None))
    return vecs.sparkSession.createDataFrame([(i, s) for i, (s, _) in enumerate(chosen, 1)], "pick int, seed long")


def two_level(vecs: DataFrame, topics: int, sections: int, rounds: int = 60) -> DataFrame:
    """(id, topic, section, is_center): topics of the items, sections of the size-weighted topic centroids."""
    first, cents = spherical_kmeans(vecs, topics, rounds=rounds)
    first = cut_lineage(first)
    sizes = first.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("w"))
    upper = cents.join(sizes, "cluster").select(F.col("cluster").alias("id"), F.col("centroid").alias("vec"), "w")
    second, _ = spherical_kmeans(upper, sections, weight="w", rounds=rounds)
    named = first.join(cents, "cluster").withColumn("sim", v.dot("vec", "centroid"))
    center = named.groupBy("cluster").agg(F.min_by("id", F.struct(-F.col("sim"), F.col("id"))).alias("center"))
    out = named.join(center, "cluster").join(second.select(F.col("id").alias("cluster"), F.col("cluster").alias("section")), "cluster")
    return out.select("id", F.col("cluster").alias("topic"), "section", (F.col("id") == F.col("center")).alias("is_center"))


def sense_split(items: DataFrame, min_side: int = 3, rounds: int = 25) -> DataFrame:
    """Two-means of each item's vectors, all items at once; score = separation × balance.

    The vectors stay rows: each round assigns them to their item's two
    centroids by a join and recomputes the centroids from partial sums, so an
    item with very many vectors is no single task.  The first seed of an item
    is the vector with the lowest id hash, the second the one farthest from it.
    """
    rows = cut_lineage(items.select("item", "id", "vec"))
    a = rows.groupBy("item").agg(F.min_by("vec", F.struct(F.xxhash64("id"), F.col("id"))).alias("ca"))
    far = rows.join(a, "item").groupBy("item").agg(F.min_by("vec", F.struct(F.round(v.dot("vec", "ca"), 9), F.col("id"))).alias("cb"))
    cents = a.join(far, "item")
    before = None
    for i in range(rounds):
        side = F.when(F.round(v.dot("vec", "ca"), 9) >= F.round(v.dot("vec", "cb"), 9), 0).otherwise(1)
        placed = cut_lineage(rows.join(cents, "item").select("item", "id", "vec", side.alias("side")))
        sums = v.centroids(placed, ["item", "side"])
        cents = sums.groupBy("item").agg(F.max(F.when(F.col("side") == 0, F.col("centroid"))).alias("ca"), F.max(F.when(F.col("side") == 1, F.col("centroid"))).alias("cb"), F.max(F.when(F.col("side") == 0, F.col("n"))).alias("n_a"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("n_b"))
        cents = cut_lineage(cents.filter("n_a IS NOT NULL AND n_b IS NOT NULL"))
        mark = placed.agg(F.sum(F.xxhash64("id", "side").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            break
        before = mark
    out = cents.filter((F.col("n_a") >= min_side) & (F.col("n_b") >= min_side))
    sep = 1 - v.dot("ca", "cb")
    score = F.round(sep * F.least("n_a", "n_b") / F.greatest("n_a", "n_b"), 3)
    return out.select("item", (F.col("n_a") + F.col("n_b")).alias("n"), "n_a", "n_b", score.alias("score"), "ca", "cb")


def clean_up(members: DataFrame, min_size: int, merge_at: float) -> DataFrame:
    """(id, cluster): small clusters dissolve to the nearest large one, near-equal large ones merge.

    Merging follows chains over the centroids as they stand after dissolving;
    the largest cluster of a chain gives its number.
    """
    from corpusloom.operators.graph import components

    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    big = size.filter(F.col("n") >= min_size)
    anchored = members.join(big, "cluster", "left_semi")
    loose = members.join(big, "cluster", "left_anti")
    moved = v.nearest_centroid(loose, v.centroids(anchored, ["cluster"]), -1.0).select("id", "cluster")
    placed = cut_lineage(anchored.select("id", "vec", "cluster").unionByName(moved.join(loose.select("id", "vec"), "id").select("id", "vec", "cluster")))
    cents = v.centroids(placed, ["cluster"])
    near = v.similar_pairs(cents.select(F.col("cluster").alias("id"), F.col("centroid").alias("vec")), merge_at).filter(F.col("score") > merge_at)
    comp = components(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    sized = cents.select(F.col("cluster").alias("node"), "n").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = sized.groupBy("component").agg(F.min_by("node", F.struct(-F.col("n"), F.col("node"))).alias("lead"))
    final = sized.join(lead, "component").select(F.col("node").alias("cluster"), "lead")
    return placed.join(final, "cluster").select("id", F.col("lead").alias("cluster"))


def disjoint_fields(knn_table: DataFrame, freq: DataFrame, strong: float, low: int = 3, high: int = 10) -> DataFrame:
    """(seed, member): tight fields around frequent seeds, no item in two fields.

    A seed takes its strong mutual neighbours that are still free.  Each round
    settles every open seed that no more frequent open seed within two steps
    could disturb, so the result is that of the walk by frequency.
    """
    both = knn_table.filter(F.col("score") >= strong).select("id", "other", "score")
    mutual = both.join(knn_table.select(F.col("other").alias("id"), F.col("id").alias("other")), ["id", "other"], "left_semi")
    mutual = cut_lineage(mutual)
    order = freq.select("id", F.struct((-F.col("freq")).alias("f"), F.col("id").alias("i")).alias("o"))
    free = cut_lineage(order)  # not in a field
    pending = free  # seeds not yet tried
    out = None
    while True:  # the most frequent open seed is settled in each round
        live = mutual.join(free.select("id"), "id", "left_semi").join(free.select(F.col("id").alias("other")), "other", "left_semi")
        step = live.join(pending.select(F.col("id").alias("other"), F.col("o").alias("oo")), "other", "left")
        around = step.groupBy("id").agg(F.min("oo").alias("m1"))
        two = live.join(around.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("m1").alias("m2"))
        mine = pending.join(around, "id", "left").join(two, "id", "left")
        ready = mine.filter((F.col("m1").isNull() | (F.col("o") < F.col("m1"))) & (F.col("m2").isNull() | (F.col("o") <= F.col("m2")))).select("id")
        ready = cut_lineage(ready)
        grown = top_k(live.join(ready, "id", "left_semi"), ["id"], [F.desc("score"), "other"], high - 1)
        sized = grown.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= low - 1)
        made = grown.join(sized, "id", "left_semi").select(F.col("id").alias("seed"), F.col("other").alias("member"))
        made = cut_lineage(made.unionByName(made.select("seed", F.col("seed").alias("member")).distinct()))
        out = made if out is None else out.unionByName(made)
        taken = made.select(F.col("member").alias("id"))
        free = cut_lineage(free.join(taken, "id", "left_anti"))
        pending = cut_lineage(pending.join(ready, "id", "left_anti").join(taken, "id", "left_anti"))
        if pending.isEmpty():
            return out


