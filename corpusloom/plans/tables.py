"""The driver tables seen as corpora, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.scale import spread

# One-to-one letter map that turns the Latin test texts into
# Arabic script, so that script-specific operators meet real rows.
LATIN = "abcdefghijklmnopqrstuvwxyzéèêäöüçñíóß0123456789"
ARABIC = "ابتثجحخديذرزسشوصضطظعغفقكلمأإآىةؤئٱَُـ٠١٢٣٤٥٦٧٨٩"


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pair_id(a, b) -> Column:
    """Two key columns as one readable id; unlike a packed number it never collides."""
    return F.concat_ws(":", a, b)


def arabic(c: Column) -> Column:
    return F.translate(F.lower(c), LATIN, ARABIC)


def arabic_sql(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{ARABIC}')"


SP = "[ \\t\\r\\n]+"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SP}'), lambda z: z <> '')"


def fold_sql(x: str, preset: str = "latin") -> str:
    drop, src, dst = tx.FOLDS[preset]
    return f"translate(regexp_replace(lower({x}), '{drop}', '', 'g'), '{src}', '{dst}')"


# --- baskets: group = nation, unit = order, token = line, key = brand, subkey = part ---
def basket(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("unit_id"),
        F.col("l_linenumber").alias("tok_no"),
        F.col("l_partkey").alias("subkey"),
        F.col("l_returnflag").alias("tag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.col("l_suppkey").alias("supp"),
    )
    part = load(spark, sf, "part").select(
        F.col("p_partkey").alias("subkey"), F.col("p_brand").alias("key"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"),
        F.col("p_name").alias("surface"),
    )
    return li.join(part, "subkey")


BASKET = """tok AS (SELECT l_orderkey AS unit_id, l_linenumber AS tok_no, l_partkey AS subkey, l_returnflag AS tag,
 l_linestatus AS status, CAST(l_quantity AS BIGINT) AS qty, l_suppkey AS supp, p_brand AS key, p_type AS kind, p_size AS size, p_name AS surface
 FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def basket_units(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("unit_id"),
        F.col("c_nationkey").alias("grp"),
        F.col("c_mktsegment").alias("attr"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("prio"),
        F.to_date("o_orderdate").alias("day"),
    )


BASKET_UNITS = """unit AS (SELECT o_orderkey AS unit_id, c_nationkey AS grp, c_mktsegment AS attr, o_orderstatus AS ustatus,
 o_orderpriority AS prio, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON c_custkey = o_custkey)"""


# --- documents: group = source, unit = document, token = word, key = 4-letter stem ---
def doc_folds(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document with the folds of its words, for counts that need no row per token."""
    return spread(load(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("unit_id"), F.col("source").alias("grp"), F.col("lang").alias("attr"), tx.folds(F.col("text")).alias("items"))


def doc_tokens(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """The words of the documents, or of those whose unit_id is in ``only``."""
    d = load(spark, sf, "documents")
    d = d if only is None else d.join(only.select(F.col("unit_id").alias("doc_id")), "doc_id", "left_semi")
    d = spread(d, "doc_id").select(
        F.col("doc_id").alias("unit_id"), F.col("source").alias("grp"), F.col("lang").alias("attr"), F.posexplode(tx.folded_words(F.col("text"))).alias("i", "w")
    )
    sub = F.nullif(F.col("w.fold"), F.lit(""))
    return d.select("unit_id", "grp", "attr", (F.col("i") + 1).alias("tok_no"), F.col("w.surface").alias("surface"), sub.alias("subkey"), F.substring(sub, 1, 4).alias("key"))


def doc_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """(surface, subkey, n): how often each word form stands in the documents.  Forms are
    counted before they are folded, so that a fold runs once per form and not once per
    token; a filter on ``subkey`` would be pushed below the count and undo that."""
    d = spread(load(spark, sf, "documents"), "doc_id").select(F.explode(tx.words(F.col("text"))).alias("surface"))
    return d.groupBy("surface").agg(F.count(F.lit(1)).alias("n")).select("surface", F.nullif(tx.fold(F.col("surface"), "latin"), F.lit("")).alias("subkey"), "n")


def doc_tokens_with_next(spark: SparkSession, sf: str) -> DataFrame:
    """The document tokens with the surface of the following one, taken within the row of the text."""
    d = spread(load(spark, sf, "documents"), "doc_id").select(F.col("source").alias("grp"), F.col("lang").alias("attr"), tx.folded_words(F.col("text")).alias("w"))
    following = F.slice(F.transform("w", lambda x: x["surface"]), 2, F.greatest(F.size("w"), F.lit(1)))
    d = d.select("grp", "attr", F.explode(F.arrays_zip(F.col("w").alias("w"), following.alias("next"))).alias("x"))
    return d.select("grp", "attr", F.col("x.w.surface").alias("surface"), F.nullif(F.col("x.w.fold"), F.lit("")).alias("subkey"), F.col("x.next").alias("next_surface"))


DOC_TOK = f"""tok AS (SELECT unit_id, grp, attr, tok_no, surface, nullif(f,'') AS subkey, substr(nullif(f,''),1,4) AS key FROM
 (SELECT unit_id, grp, attr, tok_no, surface, {fold_sql('surface')} AS f FROM
  (SELECT doc_id AS unit_id, source AS grp, lang AS attr, unnest(ws) AS surface, generate_subscripts(ws,1) AS tok_no FROM
   (SELECT doc_id, source, lang, {words_sql('text')} AS ws FROM documents))))"""


# --- conversations: group = conversation, unit = turn ---
def turns(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select(
        F.col("conv_id").alias("grp"), (F.col("turn") + 1).alias("pos"), "role", "text"
    )


TURNS = "turns AS (SELECT conv_id AS grp, turn + 1 AS pos, role, text FROM conversations)"


def turn_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = spread(turns(spark, sf), "pos").select("grp", "pos", "role", F.posexplode(tx.folded_words(F.col("text"))).alias("i", "w"))
    sub = F.nullif(F.col("w.fold"), F.lit(""))
    return t.select("grp", "pos", "role", (F.col("i") + 1).alias("tok_no"), F.col("w.surface").alias("surface"), sub.alias("subkey"), F.substring(sub, 1, 4).alias("key"))


TURN_TOK = f"""ttok AS (SELECT grp, pos, role, tok_no, surface, nullif(f,'') AS subkey, substr(nullif(f,''),1,4) AS key FROM
 (SELECT grp, pos, role, tok_no, surface, {fold_sql('surface')} AS f FROM
  (SELECT conv_id AS grp, turn+1 AS pos, role, unnest(ws) AS surface, generate_subscripts(ws,1) AS tok_no FROM
   (SELECT conv_id, turn, role, {words_sql('text')} AS ws FROM conversations))))"""


# --- vectors ---
def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label")
    )


VEC = "vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS label FROM embeddings)"
