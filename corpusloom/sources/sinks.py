"""Writers and table maintenance: vectors, graphs, partitioned exports, bundles, upserts, registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.vectors import quantise


def write_vectors(vecs: DataFrame, path: str) -> None:
    """Quantised vectors as parquet: (id, scale, q)."""
    q = vecs.select("id", quantise("vec").alias("s"))
    q.select("id", F.col("s.scale").alias("scale"), F.col("s.q").alias("q")).write.mode("overwrite").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as CSV folders with headers, written in parallel."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_by_group(rows: DataFrame, path: str, keys: Sequence[str] = ("source", "grp"), per_file: int = 200000) -> DataFrame:
    """JSON partitioned by source and group, and the manifest of rows and characters.

    Rows spread by key and a hash part, so a crowded group is several files,
    each of at most ``per_file`` rows.
    """
    spread = rows.withColumn("_p", F.pmod(F.xxhash64(*rows.columns), F.lit(16)))
    spread.repartition(*keys, "_p").drop("_p").write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy(*keys).json(path)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))


def write_bundle(sheets: dict[str, DataFrame], path: str) -> DataFrame:
    """One parquet folder per sheet and a (sheet, rows) list read back from what was written."""
    out = None
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        n = df.sparkSession.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("rows"))
        row = n.select(F.lit(name).alias("sheet"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last in ``order``, then by its other columns, so
    the choice never depends on how the rows are dealt."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    by = F.struct(*order, *[c for c in rest if c not in order])
    best = rows.groupBy(*keys).agg(F.max(by).alias("_last"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """New rows replace old ones with the same key, the last in ``order`` if a
    key comes twice; running it twice changes nothing."""
    fresh = last_per_key(new, keys, order)
    return existing.join(fresh, list(keys), "left_anti").unionByName(fresh)


def replace_source(new: DataFrame, path: str) -> None:
    """Rewrite only the partitions of the sources that ``new`` holds."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def pending(items: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items that have no result yet."""
    return items.join(results, list(keys), "left_anti")


def registry(datasets: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(name, rows, chars, avg_chars) per dataset; the text column is optional."""
    out = None
    for name, (df, text) in datasets.items():
        n = F.length(text) if text else F.lit(None).cast("int")
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(n).alias("chars"), F.round(F.avg(n), 2).alias("avg_chars")).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def archive(items: DataFrame, verdicts: DataFrame, reviews: DataFrame, size: int = 1000) -> DataFrame:
    """JSON lines of every judged item with its verdicts in bounded parts; unreviewed ones say so."""
    from corpusloom.functions.scale import collect_chunked

    v = verdicts.join(reviews, ["hub", "target"], "left").withColumn("review", F.coalesce("review", F.lit("unreviewed")))
    parts = collect_chunked(v, ["hub"], ["target"], {"verdicts": F.struct("target", "rel", "review")}, size)
    rows = items.join(parts, "hub", "left")
    none = F.array().cast("array<struct<target:bigint,rel:string,review:string>>")
    return rows.select("hub", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(F.struct("hub", F.coalesce("verdicts", none).alias("verdicts"))).alias("line"))
