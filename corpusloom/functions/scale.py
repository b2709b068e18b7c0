"""Building blocks that keep ordered and pairwise work distributed.

Spark windows put one window partition in one task, so a group that holds a
third of the rows would be one slow task.  The helpers here split such groups
over range partitions (``scan``, ``neighbours``), cut long lists into bounded
rows (``collect_chunked``) and cut lineage through the cluster's shared
checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a local session that
    lacks the setting, as in tests, gets a folder of its own, one per run."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        run = spark.sparkContext.applicationId
        folder = _LOCAL.get(run) or _LOCAL.setdefault(run, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.  Unlike a
    checkpoint this runs the plan once and tells the planner the size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes a table made by ``kept`` that no later step reads."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan of few splits over all cores before costly row work; a scan
    that already has as many splits as cores is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def range_slices(df: DataFrame, order: Sequence) -> DataFrame:
    """Sort the rows over range partitions and fix the slice number of each row."""
    n = shuffle_width(df.sparkSession)
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    out = df.repartitionByRange(n, *cols).withColumn("_slice", F.spark_partition_id())
    return cut_lineage(out)


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def scan(df: DataFrame, group: Sequence[str], order: Sequence, outputs: dict[str, tuple[str, Column]], before_only: bool = False) -> DataFrame:
    """Running ``sum``/``max``/``min`` inside groups, in ``order``.

    ``before_only`` leaves the current row out of its own result.

    The window runs per (slice, group), so a hot group is spread over slices;
    what earlier slices contribute is a table of at most two rows per slice.
    ``order`` must decide the position of every row of a group.
    """
    group = list(group)
    sliced = range_slices(df, [*group, *order])
    inside = (
        Window.partitionBy("_slice", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if before_only else Window.currentRow)
    )
    local = sliced
    for name, (fn, value) in outputs.items():
        local = local.withColumn(name, _MERGE[fn](value).over(inside))
    totals = sliced.groupBy("_slice", *group).agg(
        *[_MERGE[fn](value).alias(f"_t_{name}") for name, (fn, value) in outputs.items()]
    )
    # only groups that span slices need a carry: at most two per slice
    if group:
        spans = totals.groupBy(*group).agg(F.count(F.lit(1)).alias("_spans")).filter("_spans > 1").drop("_spans")
        totals = null_safe_join(totals, spans, group, "left_semi")
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        "_slice",
        *group,
        *[_MERGE[fn](F.col(f"_t_{name}")).over(earlier).alias(f"_c_{name}") for name, (fn, _) in outputs.items()],
    )
    joined = null_safe_join(local, carry, ["_slice", *group], "left")
    for name, (fn, _) in outputs.items():
        a, c = F.col(name), F.col(f"_c_{name}")
        if fn == "sum":
            both = F.when(c.isNull(), a).when(a.isNull(), c).otherwise(a + c)
        elif fn == "max":
            both = F.greatest(a, c)
        else:
            both = F.least(a, c)
        joined = joined.withColumn(name, both)
    return joined.drop("_slice", *[f"_c_{n}" for n in outputs])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; right keys are dropped."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def ordinal(df: DataFrame, order: Sequence, group: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """1-based position, global or per group, without a single-task window."""
    return scan(df, group, order, {out: ("sum", F.lit(1).cast("long"))})


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence, cols: Sequence[str], before: int, after: int) -> DataFrame:
    """Attach ``near``: map offset → struct(cols) of rows at -before..+after.

    Rows travel to their neighbours' positions by an equi-join on the group
    and position, so no task holds a whole group.
    """
    group = list(group)
    pos = ordinal(df, order, group, "_pos")
    sent = pos.select(
        *group,
        F.struct(*cols).alias("_v"),
        F.col("_pos").alias("_from"),
        F.explode(F.sequence(F.col("_pos") - after, F.col("_pos") + before)).alias("_to"),
    )
    gathered = sent.groupBy(*group, F.col("_to").alias("_pos")).agg(
        F.map_from_entries(
            F.collect_list(F.struct((F.col("_from") - F.col("_to")).cast("int").alias("k"), F.col("_v").alias("v")))
        ).alias("near")
    )
    return pos.join(gathered, [*group, "_pos"])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence, k, out: str | None = None) -> DataFrame:
    """First ``k`` rows per ``by``; Spark pre-limits each group before its shuffle."""
    name = out or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= k)
    return ranked if out else ranked.drop(name)


def collect_chunked(df: DataFrame, group: Sequence[str], order: Sequence, items: dict[str, Column], size: int) -> DataFrame:
    """One row per (group, part) with ordered arrays of at most ``size`` items."""
    pos = ordinal(df, order, group, "_pos").withColumn("part", F.floor((F.col("_pos") - 1) / size).cast("long"))
    packed = pos.groupBy(*group, "part").agg(
        F.array_sort(F.collect_list(F.struct("_pos", *[c.alias(n) for n, c in items.items()]))).alias("_all")
    )
    return packed.select(*group, "part", *[F.col("_all").getField(n).alias(n) for n in items])


def pairs_within(members: DataFrame, group: str, item: str, cell: int = 512, weight: Column | None = None) -> DataFrame:
    """Pairs ``a < b`` of distinct items that share a group, one row per shared
    (group-block) with ``n`` = number of sharing groups in the block.

    ``members`` must hold distinct (group, item) rows.  Items fall into blocks
    of about ``cell`` by hash, so an array never outgrows a block however
    large its group is; a group of at most ``cell`` items stays whole, as blocks
    of it would be many and nearly empty.  Equal blocks of different groups
    (copies) are folded into one row with a multiplicity before any pair is formed.
    """
    vocab = members.agg(F.approx_count_distinct(item)).first()[0]
    blocks = max(1, -(-int(vocab * 1.1) // cell))
    wt = F.lit(1).cast("long") if weight is None else weight
    base = members.select(F.col(group).alias("g"), F.col(item).alias("i"), wt.alias("w"))
    if blocks == 1:
        return _pairs_in_bags(base)
    base = kept(base, "members")
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    small = _pairs_in_bags(base.join(sizes.filter(F.col("n") <= cell), "g", "left_semi"))
    base = base.join(sizes.filter(F.col("n") > cell), "g", "left_semi")
    tagged = base.withColumn("blk", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    bags = tagged.groupBy("g", "blk").agg(F.array_sort(F.collect_list("i")).alias("items"), F.max("w").alias("w"))
    left = bags.select("g", "w", F.col("blk").alias("lb"), F.col("items").alias("li"))
    right = bags.select("g", F.col("blk").alias("rb"), F.col("items").alias("ri"))
    both = left.join(right, "g").filter("lb <= rb")
    folded = both.groupBy("lb", "rb", "li", "ri").agg(F.sum("w").alias("n"))
    pairs = folded.select("lb", "rb", "n", F.explode("li").alias("x"), "ri").select(
        "lb", "rb", "n", "x", F.explode("ri").alias("y")
    )
    pairs = pairs.filter("(lb < rb) OR (x < y)")
    return small.unionByName(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n"))


def _pairs_in_bags(base: DataFrame) -> DataFrame:
    """The pairs of groups of which each fits an array; equal groups are folded."""
    bags = base.groupBy("g").agg(F.array_sort(F.collect_list("i")).alias("left_items"), F.max("w").alias("w"))
    folded = bags.filter(F.size("left_items") > 1).groupBy("left_items").agg(F.sum("w").alias("n"))
    at = folded.select("left_items", "n", F.explode(F.sequence(F.lit(1), F.size("left_items") - 1)).alias("p"))
    return at.select(F.element_at("left_items", F.col("p")).alias("a"), F.explode(F.expr("slice(left_items, p + 1, size(left_items))")).alias("b"), "n")
