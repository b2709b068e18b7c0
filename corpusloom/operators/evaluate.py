"""Sampling, agreement, threshold search, build reports and work batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import ordinal, scan


def half_of(key: Column) -> Column:
    """tune or holdout by the digest of a key; rows with one key stay together."""
    return F.when(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 2 == 0, "tune").otherwise("holdout")


def every_nth(df: DataFrame, order: Sequence[str], step: int) -> DataFrame:
    return ordinal(df, order, out="_rn").filter((F.col("_rn") - 1) % step == 0).drop("_rn")


def lowest_digests(df: DataFrame, key: Column, n: int, *ties: str) -> DataFrame:
    return df.withColumn("_k", F.md5(key)).orderBy("_k", *ties).limit(n).drop("_k")


def grid_search(items: DataFrame, grid: dict[str, Sequence[int]], hit: Column, must: Column | None = None, prefer_small: bool = True) -> DataFrame:
    """Score of every threshold setting on ``items``; the best first by (score, sum of thresholds).

    The grid is a literal array exploded on each item, summed before the
    shuffle.  ``must`` marks items every eligible setting has to get right.
    """
    names = list(grid)
    combos = [()]
    for n in names:
        combos = [(*c, v) for c in combos for v in grid[n]]
    settings = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c)]) for c in combos])
    rows = items.withColumn("_g", F.explode(settings)).withColumns({n: F.col(f"_g.{n}") for n in names})
    ok = F.coalesce(hit, F.lit(False))
    need = F.lit(False) if must is None else must
    out = rows.groupBy(*names).agg(F.count(F.when(ok, 1)).alias("score"), F.count(F.lit(1)).alias("items"), F.count(F.when(need & ~ok, 1)).alias("broken"))
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    best = out.filter("broken = 0").agg(F.min_by(F.struct(*names), F.struct(-F.col("score"), total if prefer_small else -total, *names)))
    return out.withColumn("best", F.struct(*names) == best.scalar())


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two yes/no columns, and the variant with averaged margins."""
    c = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(a) & F.col(b), 1)).alias("both"), F.count(F.when(~F.col(a) & ~F.col(b), 1)).alias("neither"),
        F.count(F.when(F.col(a), 1)).alias("na"), F.count(F.when(F.col(b), 1)).alias("nb"),
    )
    po = (F.col("both") + F.col("neither")) / F.col("n")
    pa, pb = F.col("na") / F.col("n"), F.col("nb") / F.col("n")
    pe = pa * pb + (1 - pa) * (1 - pb)
    pm = (F.col("both") + (F.col("n") - F.col("both") - F.col("neither")) / 2) / F.col("n")
    pq = pm * pm + (1 - pm) * (1 - pm)
    return c.select("n", "both", "neither", F.round(po, 6).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"), F.round(F.try_divide(po - pq, 1 - pq), 6).alias("kappa_averaged"))


def relation_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Among links both annotators made, how many have the same relation."""
    both = first.join(second.withColumnRenamed("rel", "rel2"), ["src", "dst"])
    return both.agg(F.count(F.lit(1)).alias("both"), F.count(F.when(F.col("rel") == F.col("rel2"), 1)).alias("same"))


def holdout_exam(items: DataFrame, min_recall: float, min_rejection: float) -> DataFrame:
    """Recall of positives, rejection of negatives, and whether the declared limits hold."""
    e = items.agg(
        F.count(F.when(F.col("positive"), 1)).alias("positives"), F.count(F.when(~F.col("positive"), 1)).alias("negatives"),
        F.avg(F.when(F.col("positive"), F.col("found").cast("double"))).alias("recall"), F.avg(F.when(~F.col("positive"), (~F.col("found")).cast("double"))).alias("rejection"),
    )
    return e.select("positives", "negatives", F.round("recall", 6).alias("recall"), F.round("rejection", 6).alias("rejection"), ((F.col("recall") >= min_recall) & (F.col("rejection") >= min_rejection)).alias("passed"))


def sensitivity(items: DataFrame, label, base: dict[str, int]) -> DataFrame:
    """Labels that flip when one threshold moves by one; ``label`` maps thresholds to a column."""
    moves = []
    for n in base:
        for d in (-1, 1):
            moves.append({**base, n: base[n] + d})
    lits = lambda c: {k: F.lit(v) for k, v in c.items()}
    flips = [F.count(F.when(label(**lits(m)) != label(**lits(base)), 1)).alias(f"m{i}") for i, m in enumerate(moves)]
    one = items.agg(F.count(F.lit(1)).alias("total"), *flips)
    rows = F.array(*[F.struct(*[F.lit(m[n]).alias(n) for n in base], F.col(f"m{i}").alias("flips")) for i, m in enumerate(moves)])
    return one.select("total", F.explode(rows).alias("r")).select("r.*", "total")


def build_report(checks: Sequence[tuple[str, DataFrame, int | None]]) -> DataFrame:
    """(name, got, want, ok) of one-row counts."""
    out = None
    for name, df, want in checks:
        got = df.agg(F.count(F.lit(1)).alias("got"))
        row = got.select(F.lit(name).alias("name"), "got", F.lit(want).cast("long").alias("want"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("want").isNull() | (F.col("got") == F.col("want")))


def require(report: DataFrame) -> None:
    """Raise with the names of failed checks."""
    bad = [r["name"] for r in report.filter("NOT ok").select("name").collect()]
    if bad:
        raise ValueError("failed checks: " + ", ".join(bad))


def consistency(entries: DataFrame, vectors: DataFrame, manifest: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Per source: entries and vectors against the manifest, and rows with an unknown kind."""
    e = entries.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.count(F.when(~F.col("kind").isin(*allowed), 1)).alias("bad_kinds"))
    v = vectors.groupBy("source").agg(F.count(F.lit(1)).alias("vectors"))
    out = manifest.join(e, "source", "left").join(v, "source", "left").fillna(0, ["entries", "vectors", "bad_kinds"])
    return out.withColumn("ok", (F.col("entries") == F.col("count")) & (F.col("vectors") == F.col("entries")) & (F.col("bad_kinds") == 0))


def tiling_coverage(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    covered = spans.groupBy("grp").agg(F.sum(F.col("last") - F.col("first") + 1).alias("covered"))
    out = sizes.join(covered, "grp", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.withColumn("whole", F.col("covered") == F.col("size"))


def work_batches(groups: DataFrame, target: int = 100) -> DataFrame:
    """(grp, n, batch): whole groups packed in order by running size, batch = floor(items before / target).

    A batch starts at a fixed multiple of ``target`` rather than when the
    last one overflowed, so it can be computed in parallel; no group is split.
    """
    ran = scan(groups.select("grp", "n"), [], ["grp"], {"_before": ("sum", F.col("n"))}, before_only=True)
    return ran.select("grp", "n", F.floor(F.coalesce("_before", F.lit(0)) / target).cast("long").alias("batch"))


def waves(batches: DataFrame, swarms: int = 9, per_wave: int = 3, repeat: float = 0.05, salt: str = "w") -> DataFrame:
    """(batch, swarm, wave, repeated): batches in hash order dealt to swarms; the first
    ``repeat`` share of each swarm is judged twice."""
    b = batches.select("batch").distinct().withColumn("_h", F.md5(F.concat(F.lit(salt), F.col("batch").cast("string"))))
    total = b.agg(F.count(F.lit(1)))
    dealt = ordinal(b, ["_h", "batch"], out="_rn").withColumn("_w", F.ceil(total.scalar() / swarms))
    dealt = dealt.withColumn("swarm", F.floor((F.col("_rn") - 1) / F.col("_w")).cast("long"))
    place = (F.col("_rn") - 1) % F.col("_w")
    return dealt.select("batch", "swarm", F.floor(F.col("swarm") / per_wave).cast("long").alias("wave"), (place < F.ceil(F.col("_w") * repeat)).alias("repeated"))


def missing_ids(done: DataFrame, spark_range: DataFrame) -> DataFrame:
    return spark_range.join(done.select("id").distinct(), "id", "left_anti")


def missing_runs(missing: DataFrame) -> DataFrame:
    """(first, last, n): missing ids as runs."""
    placed = ordinal(missing.select("id").distinct(), ["id"], out="_rn")
    return placed.groupBy((F.col("id") - F.col("_rn")).alias("_k")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).drop("_k")


def tallies(verdicts: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Verdict counts per batch and over all (batch null)."""
    cols = [F.count(F.when(F.col("verdict") == k, 1)).alias(k) for k in kinds]
    return verdicts.rollup("batch").agg(*cols, F.count(F.lit(1)).alias("total"))


def lost_pairs(before: DataFrame, judged: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Unordered pairs accepted before and judged again, but not confirmed."""
    def norm(df):
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    return norm(before).join(norm(judged), ["a", "b"], "left_semi").join(norm(confirmed), ["a", "b"], "left_anti")
