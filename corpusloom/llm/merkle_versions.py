"""Merkle manifest of a dataset as a persistent, path-copying tree.

A row becomes a leaf; the leaves of a source, by id, form a tree in which every
three consecutive nodes of a level have their hash above them, and the roots of
all sources form the tree above.  A change of a leaf makes a version: its
ancestors are copied with new hashes, every other node is that of the first
version.  Nothing is rebuilt and no version copies more than one path.

Levels are built by aligned blocks of 3^7 nodes, one task row each, whatever a
source holds; block roots are the nodes of the next, 2,187 times smaller round.
The path above a block travels down to it once, so the copies of a version go
on from the block up to the root in the task that holds the leaf.

H is the lowercase hex SHA-256 of concatenated texts, digests as hex.

Defined results: null values enter a leaf as ``-``, empty texts as ``0:``; a
null source is a source of its own, before the others.  Leaves of one id are
ordered by leaf, null ids come first and, like all ids, count by their text
(none: empty) when versions are chosen.  Repeated rows are leaves like any
other.  A table with one row has that leaf as its root and an empty proof.  An
empty table gives an empty result.  Only ``doc_id``, ``source``, ``lang``,
``n_chars`` and ``text`` are read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import ordinal
from corpusloom.llm.common import stored

FAN, HEIGHT = 3, 7  # a block has FAN**HEIGHT nodes
NODE = "tree string, level int, idx long, hash string, total long"
PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], encoded(text)), 256)


def without_line_feeds(docs: DataFrame, one_in: int = 2) -> DataFrame:
    """``docs`` with ``changed``: the text without line feeds in rows whose crc32
    of the id divides by ``one_in``, null elsewhere."""
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % one_in == 0
    return docs.select("doc_id", "source", "lang", "n_chars", "text", hit.alias("hit")).withColumn("changed", F.when(F.col("hit"), F.replace("text", F.lit("\n"), F.lit(""))))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, idx, total, doc_id, hash, new): the leaves of every source in order,
    and the leaf after the change where ``hit`` says that there is one.

    ``tree`` is ``n`` for no source and ``s`` before the name of any other, so
    that trees in order of their bytes are sources in order.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf_of(F.col("text")).alias("hash"), F.when(F.col("hit"), leaf_of(F.col("changed"))).alias("new"))
    rows = stored(rows, "merkle-leaves")
    placed = ordinal(rows, ["doc_id", "hash"], ["tree"], "idx").withColumn("idx", F.col("idx") - 1)
    return placed.join(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("total")), "tree")


def climb(total: int, height: int) -> int:
    """Levels from the nodes of a block to its root, of ``total`` nodes in the tree."""
    rise = 0
    while total > 1 and rise < height:
        total, rise = -(-total // FAN), rise + 1
    return rise


def build(hashes: list[str], total: int, height: int) -> list[list[str]]:
    """All levels of a block, its nodes first, its root last."""
    out = [hashes]
    for _ in range(climb(total, height)):
        below = out[-1]
        out.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def path_up(block: list[list[str]], i: int) -> list[dict[str, str]]:
    """What stands left and right of node ``i`` and of each of its ancestors."""
    out = []
    for level in block[:-1]:
        first = i - i % FAN
        out.append({"left": "".join(level[first:i]), "right": "".join(level[i + 1 : first + FAN])})
        i //= FAN
    return out


def copies(node: str, path: list[dict[str, str]]) -> list[str]:
    """The ancestors of a node with their hashes once it is ``node``."""
    out = []
    for p in path:
        node = digest(p["left"] + node + p["right"])
        out.append(node)
    return out


def _block(height: int) -> Column:
    return F.floor(F.col("idx") / FAN**height).cast("long").alias("block")


def block_roots(nodes: DataFrame, height: int, every: bool = False) -> DataFrame:
    """The root of each block as a node of the next round; with ``every``, all
    nodes above those of the block, with their level and index."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        tree, total, first = t["tree"][0].as_py(), t["total"][0].as_py(), t["idx"][0].as_py()
        low = t["level"][0].as_py()
        levels = build(t["hash"].to_pylist(), total, height)
        rows = []
        for k, level in enumerate(levels):
            if k == len(levels) - 1 or (every and k):
                size = -(-total // FAN**k)
                rows += [(tree, low + k, first // FAN**k + i, h, size) for i, h in enumerate(level)]
        return pa.table({n: pa.array(c, ty) for n, c, ty in zip(("tree", "level", "idx", "hash", "total"), zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()))})

    return nodes.select("tree", "level", "idx", "hash", "total", _block(height)).groupBy("tree", "block").applyInArrow(run, NODE)


def upper_paths(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, idx, path, top) of every node: its path to the root of its tree."""
    if (nodes.agg(F.max("total")).first()[0] or 0) <= FAN**height:
        above = nodes.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("top")).distinct()
    else:
        above = upper_paths(stored(block_roots(nodes, height), "merkle-nodes"), height).withColumnRenamed("idx", "block")

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        block = build(t["hash"].to_pylist(), t["total"][0].as_py(), height)
        more, top = up["path"][0].as_py(), up["top"][0].as_py() or block[-1][0]
        n = len(t)
        paths = pa.array([path_up(block, i) + more for i in range(n)], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        return pa.table({"tree": t["tree"], "idx": t["idx"], "path": paths, "top": pa.array([top] * n, pa.string())})

    own = nodes.select("tree", "idx", "hash", "total", _block(height)).groupBy("tree", "block")
    return stored(own.cogroup(above.select("tree", "block", "path", "top").groupBy("tree", "block")).applyInArrow(run, f"tree string, idx long, path {PATH}, top string"), "merkle-paths")


def block_paths(placed: DataFrame, height: int) -> DataFrame:
    """(tree, block, path, subroot, root): the way from each block of leaves up to the root of all."""
    roots = stored(block_roots(placed.withColumn("level", F.lit(0)), height), "merkle-nodes")
    # a whole block rises by ``height`` levels, so a block root is node ``block`` of its level
    inside = upper_paths(roots.withColumn("level", F.lit(0)), height)
    tops = inside.filter("idx = 0").select("tree", F.col("top").alias("hash"))
    sources = ordinal(tops, ["tree"], (), "idx").select(F.lit("").alias("tree"), F.col("tree").alias("of"), (F.col("idx") - 1).alias("idx"), "hash")
    sources = stored(sources.withColumn("total", F.lit(tops.count()).cast("long")).withColumn("level", F.lit(0)), "merkle-sources")
    across = sources.select("of", "idx").join(upper_paths(sources.drop("of"), height).select("idx", F.col("path").alias("more"), F.col("top").alias("root")), "idx")
    joined = inside.join(across.select(F.col("of").alias("tree"), "more", "root"), "tree")
    return joined.select("tree", F.col("idx").alias("block"), F.concat("path", "more").alias("path"), F.col("top").alias("subroot"), "root")


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, idx, doc_id, leaf, subroot, root, proof, hit, copied, folded_root,
    verified), one row per row of ``docs``, which has the columns of
    ``without_line_feeds``.

    ``proof`` holds the siblings from the leaf up to the root, left to right;
    ``copied`` the ancestors, bottom up, of the version that holds the changed
    leaf, or of the leaf itself without a change; the last of them is
    ``folded_root``, and ``verified`` says whether it is the root.
    """
    placed = stored(leaves(docs), "merkle-placed")
    ups = block_paths(placed, height)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"tree string, idx long, doc_id {doc_id}, leaf string, subroot string, root string, proof array<string>, hit boolean, copied array<string>, folded_root string, verified boolean"

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        hashes, new = t["hash"].to_pylist(), t["new"].to_pylist()
        block = build(hashes, t["total"][0].as_py(), height)
        more, subroot, root = up["path"][0].as_py(), up["subroot"][0].as_py(), up["root"][0].as_py()
        proofs, copied = [], []
        for i, h in enumerate(hashes):
            path = path_up(block, i) + more
            beside = "".join(p["left"] + p["right"] for p in path)
            proofs.append([beside[j : j + 64] for j in range(0, len(beside), 64)])
            copied.append(copies(new[i] or h, path))
        folded = [c[-1] if c else n or h for c, n, h in zip(copied, new, hashes)]
        strings = pa.list_(pa.string())
        return pa.table({
            "tree": t["tree"], "idx": t["idx"], "doc_id": t["doc_id"], "leaf": t["hash"], "subroot": pa.array([subroot] * len(t)), "root": pa.array([root] * len(t)),
            "proof": pa.array(proofs, strings), "hit": pa.array([n is not None for n in new]), "copied": pa.array(copied, strings), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
        })

    own = placed.select("tree", "idx", "total", "doc_id", "hash", "new", _block(height)).groupBy("tree", "block")
    return own.cogroup(ups.groupBy("tree", "block")).applyInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """The manifest with one digest per proof."""
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def source_nodes(placed: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, level, idx, hash): the first version of all nodes of every source."""
    rounds, below = [], placed.withColumn("level", F.lit(0)).select("tree", "level", "idx", "hash", "total")
    out = below
    while (below.agg(F.max("total")).first()[0] or 0) > 1:
        rounds.append(stored(block_roots(below, height, every=True), "merkle-levels"))
        # a tree that ended inside this round has its root as its only node there
        above = rounds[-1].filter((F.col("level") == height * len(rounds)) & (F.col("total") > 1))
        out, below = out.unionByName(rounds[-1]), above
    return out.select("tree", "level", "idx", "hash")


def version_nodes(rows: DataFrame) -> DataFrame:
    """(tree, version, level, idx, hash): the nodes that each version of ``manifest``
    copied; a version is named by the place of its leaf.  Levels go on past the
    root of the source into the tree of sources."""
    each = rows.filter("hit").select("tree", F.col("idx").alias("version"), F.posexplode("copied").alias("level", "hash"))
    power = F.pow(F.lit(FAN), F.col("level") + 1).cast("long")
    return each.select("tree", "version", (F.col("level") + 1).alias("level"), F.floor(F.col("version") / power).cast("long").alias("idx"), "hash")
