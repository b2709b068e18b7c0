"""Near copies by SimHash, completed to exact Jaccard similarity of word shingles.

Two documents link if their sets of five-word shingles have a Jaccard similarity
of 0.8 or more.  One pass over the texts makes, for every set, its name, its
SimHash fingerprint, its parities (bit i tells whether an odd number of its
shingles fall on i) and its prefix.  Equal sets are folded by name.

1. Pairs whose fingerprints link as in ``near_dup`` are verified first; they
   join the bulk of all copies.
2. Linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each, in
   any order that all sets have in common, so the prefixes hold whatever the
   fingerprints missed.  The order puts shingles that a sample shows to be
   frequent last, which keeps their lists short; it has no effect on the result.
   Prefixes travel packed, by ranges of shingles.
3. A list too long for all its pairs is compared in blocks by parities.  In two
   rounds each set is verified against the nearest one of another group, from
   short and long lists alike, and at last all that is left between groups.

No pair reaches its texts before sizes and parities allow it: sets that differ
in d shingles differ in at most d parities.  What is left is compared shingle
by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import null_safe_join, shuffle_width
from corpusloom.llm import near_dup
from corpusloom.llm.common import discard, release, stored, text_key, text_of
from corpusloom.operators.graph import components

WORDS = 5
SHARE = (4, 5)  # 0.8 in whole numbers
SHORT = 16  # members of a list whose pairs are all formed
MEMBERS = 2048  # of a block of a long list
TOGETHER = 64  # texts verified against one
RANGE_ROWS = 4_000_000  # packed shingles of a range


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of the five-word shingles with repeats; words as in ``simhash``,
    fewer words than a shingle make one, no word none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(WORDS, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], dtype="<u8")


def shingles(text: str) -> np.ndarray:
    """The set of shingles, sorted."""
    return np.unique(shingle_hashes(text))


def set_name(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    rare = ~np.isin(s, frequent, assume_unique=True)
    take = len(s) - -(-SHARE[0] * len(s) // SHARE[1]) + 1 if len(s) else 0
    return np.concatenate([s[rare], s[~rare]])[:take]


def parities(s: np.ndarray) -> bytes:
    """One bit per shingle and up to two, 64 at least."""
    m = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """How many shingles two sets of such parities differ in at least."""
    if len(a) < len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def may_link(n: int, sig: bytes, m: int, other: bytes) -> int | None:
    """The least difference if sets of these sizes and parities can link.

    An overlap of 4/9 (n + m), which is Jaccard 0.8, leaves (n + m) / 9 shingles that differ.
    """
    if 9 * abs(n - m) > n + m:
        return None
    d = least_difference(sig, other)
    return d if 9 * d <= n + m else None


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("text_key"), text_of().alias("text"))


def frequent_shingles(docs: DataFrame, one_in: int, least: int, most: int) -> np.ndarray:
    """Shingles of at least ``least`` documents of the sample, sorted; only the order of prefixes depends on them."""
    rows = _rows(docs).filter(F.pmod("text_key", F.lit(one_in)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], ["token"])

    often = rows.mapInArrow(run, "token long").groupBy("token").count().filter(F.col("count") >= least)
    t = often.orderBy(F.desc("count"), "token").limit(most).select("token").toArrow()
    return np.sort(t.column("token").to_numpy().view(np.uint64))


def described(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, text_key, node, n, fp, sig, prefix) of every row."""
    rows = _rows(docs)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = rows.drop("text").schema.simpleString()[7:-1] + ",node:bigint,n:int,fp:bigint,sig:binary,prefix:binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, fp, sig, pre = [], [], [], [], []
            for t in b.column("text").to_pylist():
                every = shingle_hashes(t)
                s = np.unique(every)
                node.append(set_name(s))
                n.append(len(s))
                fp.append(near_dup._signed(near_dup.majority_bits(every)))
                sig.append(parities(s))
                pre.append(prefix(s, shared.value).tobytes())
            columns = [b.column("doc_id"), b.column("text_key"), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(sig, pa.binary()), pa.array(pre, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n", "fp", "sig", "prefix"])

    return rows.mapInArrow(run, schema)


def packed(sets: DataFrame, ranges: int) -> DataFrame:
    """(range, tokens, member, nodes): the prefix shingles of a batch of sets by
    range, five bytes each, and two bytes that say whose they are.  Shingles that
    agree in these five bytes only meet in vain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1 << 15):
                b = whole.slice(lo, 1 << 15)
                nodes, first = np.unique(b.column("node").to_numpy(), return_index=True)
                tokens = [np.frombuffer(x, "<u8") for x in b.column("prefix").take(pa.array(first)).to_pylist()]
                member = np.repeat(np.arange(len(nodes)), [len(t) for t in tokens])
                token = np.concatenate([np.zeros(0, "<u8"), *tokens])
                at = (token % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(ranges + 1))
                out: list[list] = [[], [], [], []]
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = order[cuts[r] : cuts[r + 1]]
                    used, index = np.unique(member[mine], return_inverse=True)
                    short = np.ascontiguousarray(token[mine] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
                    for c, v in zip(out, (r, short.tobytes(), index.astype("<u2").tobytes(), nodes[used].astype("<i8").tobytes())):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["range", "tokens", "member", "nodes"])

    return sets.select("node", "prefix").mapInArrow(run, "range int, tokens binary, member binary, nodes binary")


def meetings(rows: DataFrame) -> DataFrame:
    """(long, a, b): pairs a < b of sets with a prefix shingle in common, and for
    lists of more than ``SHORT`` the pairs with the first member and, as ``long``,
    the members b of each shingle a."""

    def run(t: pa.Table) -> pa.Table:
        token, node = [], []
        for tokens, member, nodes in zip(t["tokens"].to_pylist(), t["member"].to_pylist(), t["nodes"].to_pylist()):
            five = np.frombuffer(tokens, np.uint8).reshape(-1, 5)
            token.append(np.pad(five, ((0, 0), (0, 3))).view("<u8").ravel())
            node.append(np.frombuffer(nodes, "<i8")[np.frombuffer(member, "<u2")])
        token, node = np.concatenate(token), np.concatenate(node)
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
        token, node = token[new], node[new]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(start, len(token)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, SHORT + 1):
            members = node[start[size == m][:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            a.append(members[:, i].ravel())
            b.append(members[:, j].ravel())
        far = size > SHORT
        inside = np.repeat(far, size)
        first = np.repeat(node[start[far]], size[far])
        pairs = np.unique(np.column_stack([np.concatenate([*a, first]), np.concatenate([*b, node[inside]])]), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        every = np.concatenate([pairs, np.column_stack([token[inside].astype(np.int64), node[inside]])])
        return pa.table({"long": pa.array(np.arange(len(every)) >= len(pairs)), "a": pa.array(every[:, 0]), "b": pa.array(every[:, 1])})

    return rows.groupBy("range").applyInArrow(run, "long boolean, a long, b long")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, d): the pairs (src, dst) whose sizes and parities allow a link."""
    side = lambda name, c: nodes.select(F.col("node").alias(name), F.struct("n", "sig").alias(c))
    both = pairs.join(side("src", "s"), "src").filter("s.n > 0").join(side("dst", "t"), "dst")
    both = both.filter("9 * abs(s.n - t.n) <= s.n + t.n").select("src", "dst", F.col("s.n").alias("n"), F.col("s.sig").alias("sig"), F.col("t.n").alias("m"), F.col("t.sig").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pa.array([may_link(*x) for x in zip(*[b.column(c).to_pylist() for c in ("n", "sig", "m", "other")])], pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c).filter(d.is_valid()) for c in ("src", "dst")], d.drop_null()], ["src", "dst", "d"])

    return both.mapInArrow(run, "src long, dst long, d int")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) that link, by their shingles."""
    dealt = pairs.select("src", "dst", F.xxhash64("dst").alias("_h"))
    many = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    dealt = dealt.join(many, "src").select("src", "dst", F.pmod("_h", F.col("parts")).alias("part"))
    left = dealt.select("src", "part").distinct().join(texts.select(F.col("node").alias("src"), F.col("text").alias("one")), "src")
    right = dealt.join(texts.select(F.col("node").alias("dst"), "text"), "dst")
    one, others = left.toDF("one_src", "one_part", "one"), right.select("src", "part", "dst", "text")

    def run(one: pa.Table, others: pa.Table) -> pa.Table:
        known = shingles(one["one"][0].as_py()) if len(one) else np.zeros(0, "<u8")
        ok = pa.array([similar(known, shingles(t.as_py())) for t in others["text"]], pa.bool_())
        return others.select(["src", "dst"]).filter(ok)

    return one.groupBy("one_src", "one_part").cogroup(others.groupBy("src", "part")).applyInArrow(run, "src long, dst long")


def fingerprint_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """(src, dst): sets whose fingerprints link, enough to connect all of them."""
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    same = nodes.join(fps, "fp").filter("node <> rep").select(F.col("rep").alias("src"), F.col("node").alias("dst"))
    near = near_dup.links(fps.select("fp"), radius)
    near = near.join(fps.toDF("src", "a"), "src").join(fps.toDF("dst", "b"), "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return same.unionByName(near)


def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs that lie in different components so far."""
    at = pairs.join(comp.toDF("src", "_a"), "src", "left").join(comp.toDF("dst", "_b"), "dst", "left")
    return at.filter(F.coalesce("_a", "src") != F.coalesce("_b", "dst")).drop("_a", "_b")


def fold(sig: bytes, size: int) -> np.ndarray:
    """Parities of ``size`` bytes, as words, from twice as many or the same."""
    x = np.frombuffer(sig, "<u8")
    return x if len(sig) == size else x[: len(x) // 2] ^ x[len(x) // 2 :]


def compared(n: np.ndarray, c: np.ndarray, sigs: list[bytes], other: np.ndarray | None, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the possible pairs of different components ``c``; with
    ``other``, of different values there only; with ``nearest``, for each place
    only the pair that differs least."""
    size = np.array([len(x) for x in sigs])
    best = np.full(len(n), np.iinfo(np.int64).max)
    mate = np.full(len(n), -1)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in np.unique(size):  # sets whose sizes allow a link have parities of the same or of twice the length
        rows, cols = np.flatnonzero(size == w), np.flatnonzero((size == w) | (size == 2 * w))
        x, y = (np.stack([fold(sigs[i], w) for i in at]) for at in (rows, cols))
        for lo in range(0, len(rows), max(1, (1 << 22) // (len(cols) * (w // 8)))):
            at = rows[lo : lo + max(1, (1 << 22) // (len(cols) * (w // 8)))]
            d = np.bitwise_count(x[lo : lo + len(at), None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
            both = n[at][:, None] + n[cols][None, :]
            ok = (9 * d <= both) & (9 * np.abs(n[at][:, None] - n[cols][None, :]) <= both) & (c[at][:, None] != c[cols][None, :])
            ok &= (size[cols] > w)[None, :] | (at[:, None] < cols[None, :])
            if other is not None:
                ok &= other[at][:, None] != other[cols][None, :]
            i, j = np.nonzero(ok)
            i, j, d = at[i], cols[j], d[i, j]
            if nearest:
                for p, q in ((i, j), (j, i)):
                    order = np.lexsort((q, d, p))
                    first = order[np.unique(p[order], return_index=True)[1]]
                    better = first[d[first] < best[p[first]]]
                    best[p[better]], mate[p[better]] = d[better], q[better]
            else:
                left.append(i), right.append(j)
    if nearest:
        return np.flatnonzero(mate >= 0), mate[mate >= 0]
    return np.concatenate(left), np.concatenate(right)


def long_list_pairs(members: DataFrame, nodes: DataFrame, comp: DataFrame, nearest: bool = False) -> DataFrame:
    """(src, dst): possible pairs of different components in lists (a: shingle, b: set),
    all of them or the ``nearest`` of each set.

    Lists of the same members count once; a list is compared in blocks, and a
    row of a block pair gives only what sizes, parities and components allow.
    """
    at = members.select("a", F.col("b").alias("node")).join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    lists = at.groupBy("a").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("name"), F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    lists = lists.filter("lo <> hi").groupBy("name", "size").agg(F.min("a").alias("a"))
    at = at.join(lists.select("a", F.ceil(F.col("size") / MEMBERS).cast("int").alias("blocks")), "a").join(nodes.select("node", "n", "sig"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    dealt = at.select("a", "node", "n", "sig", "c", mine.alias("mine"), F.explode(cell).alias("cell"))

    def run(t: pa.Table) -> pa.Table:
        node, n, c, block = (t[x].to_numpy() for x in ("node", "n", "c", "mine"))
        alone = t["i"][0].as_py() == t["j"][0].as_py()
        i, j = compared(n.astype(np.int64), c, t["sig"].to_pylist(), None if alone else block, nearest)
        return pa.table({"src": pa.array(np.minimum(node[i], node[j]), pa.int64()), "dst": pa.array(np.maximum(node[i], node[j]), pa.int64())})

    rows = dealt.select("a", "node", "n", "sig", "c", "mine", "cell.i", "cell.j")
    return rows.groupBy("a", "i", "j").applyInArrow(run, "src long, dst long").distinct()


def near_copies(docs: DataFrame, radius: int = 4, one_in: int = 64, least: int = 3, most: int = 1_000_000) -> DataFrame:
    """(doc_id, text_key, label), one row per row of ``docs``: rows of one label
    are connected over links.  Texts without a word link to each other; null
    ids and repeated rows are rows like any other; a text of any length is one
    row of one task, as its set is.  An empty table gives an empty one."""
    spark = docs.sparkSession
    sets = stored(described(docs, frequent_shingles(docs, one_in, least, most)), "described-sets")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")
    nodes = stored(sets.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("sig").alias("sig"), F.min(order).alias("k")), "distinct-sets")
    size = sets.agg(F.sum(F.octet_length("prefix")) / 8).first()[0] or 0
    ranges = max(shuffle_width(spark), int(size) // RANGE_ROWS)
    met = stored(meetings(packed(sets, ranges)), "meetings")
    marked = stored(sets.select("doc_id", "text_key", "node"), "set-names")
    discard(sets)

    state: dict[str, DataFrame] = {"comp": spark.createDataFrame([], "node long, component long")}

    def take(pairs: DataFrame) -> None:
        """Verifies the pairs and joins what links."""
        pairs = stored(pairs.select("src", "dst"), "candidates")
        if not pairs.isEmpty():
            used = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
            of = stored(nodes.join(used, "node").select("node", "k.doc_id", "k.text_key"), "candidate-ids")  # of known size, so that texts need no shuffle if it is small
            texts = stored(null_safe_join(_rows(docs), of, ["doc_id", "text_key"], "inner").groupBy("node").agg(F.min("text").alias("text")), "candidate-texts")
            found = verified(pairs, texts).unionByName(state["links"]) if "links" in state else verified(pairs, texts)
            state["links"] = stored(found, "links")
            discard(texts)
            if not state["links"].isEmpty():
                state["comp"] = components(state["links"])
        discard(pairs)
        release(spark)

    take(possible(fingerprint_pairs(nodes, radius), nodes))
    few = stored(possible(across(met.filter("not long").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), state["comp"]), nodes), "possible")
    many = met.filter("long").select("a", "b")
    no_long = many.isEmpty()
    tested = None
    for nearest in (True, True, False):  # what two rounds join is not compared in full
        pairs = across(few, state["comp"])
        if nearest:
            pairs = pairs.select("src", "dst", "d", F.explode(F.array("src", "dst")).alias("of")).groupBy("of").agg(F.min(F.struct("d", "src", "dst")).alias("p")).select("p.src", "p.dst")
        pairs = pairs.select("src", "dst")
        if not no_long:
            pairs = pairs.unionByName(long_list_pairs(many, nodes, state["comp"], nearest))
        pairs = pairs.distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["src", "dst"], "left_anti"), "pairs")
        take(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
    return marked.join(state["comp"], "node", "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("label"))


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (null
    last), of those the one with the smallest key of its text; equal rows are
    one.  Texts are not shuffled while the list of dropped rows is small enough
    to be broadcast."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    rows = near_copies(docs, **settings).groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    rows = stored(rows, "labelled")
    kept = rows.groupBy("label").agg(F.min(order).alias("k"))
    told = rows.join(kept, "label").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_key") == F.col("k.text_key")))
    told = stored(told.filter("NOT stays OR rows > 1").select("doc_id", F.col("text_key").alias("_text_key"), "stays"), "dropped")
    keyed = docs.withColumn("_text_key", text_key())
    single = null_safe_join(keyed, told.drop("stays"), ["doc_id", "_text_key"], "left_anti")
    repeated = null_safe_join(keyed, told.filter("stays").drop("stays"), ["doc_id", "_text_key"], "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return single.unionByName(repeated).drop("_text_key")
