"""Readers for corpus sources: piped text, tab-separated annotations, XML metadata, JSON trees, journals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.scale import ordinal


def read_piped(spark: SparkSession, path: str, prefix: str | None = None, keep_prefix: Sequence[int] = ()) -> DataFrame:
    """(grp, pos, text) of ``group|pos|text`` lines; blanks and # lines skipped.

    ``prefix`` is cut from the first unit of every group but ``keep_prefix``.
    """
    line = F.trim(F.col("value"))
    parts = F.split(line, "\\|", 3)
    rows = spark.read.text(path).filter((line != "") & ~F.startswith(line, F.lit("#"))).select(
        parts[0].cast("long").alias("grp"), parts[1].cast("long").alias("pos"), parts[2].alias("text")
    )
    rows = tx.normalise_columns(rows, ["text"])
    if prefix is None:
        return rows
    cut = (F.col("pos") == 1) & F.startswith("text", F.lit(prefix))
    if keep_prefix:
        cut = cut & ~F.col("grp").isin(*keep_prefix)
    return rows.withColumn("text", F.when(cut, F.trim(F.substr("text", F.lit(len(prefix) + 1)))).otherwise(F.col("text")))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(grp, pos, tok_no, seg_no, text, cls, features) of tab-separated segments; order is the address."""
    raw = spark.read.csv(path, sep="\t", schema="address string, text string, cls string, features string", quote="")
    parts = {n: tx.address_part(F.col("address"), i) for i, n in enumerate(["grp", "pos", "tok_no", "seg_no"])}
    return raw.filter(F.col("address").rlike("^[0-9]+(:[0-9]+){3}$")).withColumns(parts)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row per ``row_tag`` element; attributes arrive as fields with a leading underscore."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_lines_by_position(spark: SparkSession, path: str, sizes: DataFrame) -> DataFrame:
    """(grp, pos, text) of a line-per-unit file, keyed by the running sizes of the groups.

    A line's number is its place by file, block and row, so the file may be split.
    """
    from corpusloom.operators.model import from_ordinal, group_offsets

    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("text")
    )
    placed = ordinal(lines, ["f", "b", "i"], out="ord").select("ord", "text")
    return from_ordinal(placed, group_offsets(sizes)).select("grp", "pos", "text")


def read_unit_tree(spark: SparkSession, root: str, schema: str, group_at: str = "([0-9]+)/[0-9]+\\.json$", place_at: str = "([0-9]+)\\.json$") -> DataFrame:
    """One JSON text per unit; group and place come from the path (``<grp>/<pos>.json``), empty texts are dropped."""
    d = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    p = F.col("_metadata.file_path")
    d = d.select(F.regexp_extract(p, group_at, 1).cast("long").alias("grp"), F.regexp_extract(p, place_at, 1).cast("long").alias("pos"), "*")
    return d.withColumn("text", F.trim(F.regexp_replace("text", tx.SPACE, " "))).filter("text <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and how many lines were malformed or lacked a required field."""
    raw = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema + ", _bad string").json(path)
    broken = F.col("_bad").isNotNull()
    lacking = F.lit(False)
    for r in required:
        lacking = lacking | F.col(r).isNull()
    state = F.when(broken, "malformed").when(lacking, "incomplete").otherwise("good")
    told = raw.withColumn("state", state)
    # the corrupt-record column may not be read alone, so rows keep their fields
    good = told.filter("state = 'good'").drop("_bad", "state")
    return good, told.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count(required[0]).alias("with_key"))


def read_range_csv(spark: SparkSession, path: str) -> DataFrame:
    """(grp, first, last, topic) of rows whose first column is ``g:a-b``; other rows are dropped."""
    raw = spark.read.csv(path, schema="ref string, n int, topic string", header=False)
    part = lambda p: F.regexp_extract("ref", p, 1).try_cast("long")
    return raw.filter(F.col("ref").rlike("^[0-9]+:[0-9]+-[0-9]+$")).select(
        part("^([0-9]+):").alias("grp"), part(":([0-9]+)-").alias("first"), part("-([0-9]+)$").alias("last"), "n", "topic"
    )


def keyed_texts(df: DataFrame, key_columns: Sequence[str], text: str) -> DataFrame:
    """(key, text) with the first key column the table has; markup and empty rows dropped."""
    key = next(k for k in key_columns if k in df.columns)
    out = df.select(F.trim(F.col(key).cast("string")).alias("key"), tx.strip_html(F.col(text)).alias("text"))
    return out.filter("key <> '' AND text <> ''")


def harvest(journal: DataFrame, known: DataFrame, kind: str, order: Column) -> tuple[DataFrame, DataFrame]:
    """Verdict rows (hub, target, rel) of nested journals, and targets nobody knows.

    ``journal`` has (type, run, result.hubs[].{hub, targets[].{loc, rel}}).
    The latest row per (hub, target) by ``order`` counts.
    """
    j = journal.filter(F.col("type") == kind).select(order.alias("_o"), F.explode("result.hubs").alias("h"))
    rows = j.select("_o", F.col("h.hub").alias("hub"), F.explode("h.targets").alias("t")).select("_o", "hub", F.col("t.loc").alias("target"), F.col("t.rel").alias("rel"))
    k = known.select("id").distinct()
    good = rows.join(k.withColumnRenamed("id", "hub"), "hub", "left_semi").join(k.withColumnRenamed("id", "target"), "target", "left_semi")
    last = good.groupBy("hub", "target").agg(F.max_by("rel", F.struct("_o", "rel")).alias("rel"))
    return last, rows.join(k.withColumnRenamed("id", "target"), "target", "left_anti").select("hub", "target").distinct()


def attach_layer(units: DataFrame, layer: DataFrame, on: Sequence[str], column: str, name: str) -> DataFrame:
    """Add a text layer that must hold exactly one row per unit."""
    twice = layer.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    lacking = units.join(layer, list(on), "left_anti").limit(1).count()
    extra = layer.join(units, list(on), "left_anti").limit(1).count()
    if twice or lacking or extra:
        raise ValueError(f"layer {name}: repeated={twice} missing={lacking} unknown={extra}")
    return units.join(layer.select(*on, F.col(column).alias(name)), list(on))


