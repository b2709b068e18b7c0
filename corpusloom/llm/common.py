"""What the pipeline operators share: row keys, stored tables, text arrays for numpy.

Everywhere a null text counts as empty, a word is a run of characters other
than space and U+0009 to U+000D, and extra columns of an input are ignored
unless a function says that it passes them on.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.scale import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: later
    steps neither compute it twice nor depend on the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table written by ``stored`` that nothing reads any more."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any
    more, which it else does at the driver's next large garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """With the id, this tells rows apart: one id may come with several texts."""
    return F.xxhash64(text_of(column))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(folds))


def pieces(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters; a longer text stands alone, so
    that the arrays made from one range stay small whatever a batch holds."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and the length of each text."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, dtype="<u4"), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def text_column(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys; multiplication wraps."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def labelled_sample(labels: DataFrame, label: str, rows_per_class: int, folds: int) -> DataFrame:
    """(doc_id, y) of at most ``rows_per_class`` training rows of each class, by
    hash order of the id.  Fold 0 stays out; of repeated labels the larger counts."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.filter(fold_of("doc_id", folds) != 0)
    take = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
    return take(0).unionByName(take(1))


def first_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (a sample of bounded size, therefore broadcast) with the text of
    each id; an id with several texts gets the smallest."""
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in ids.columns if c != "doc_id"])


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its lower case where that is one point."""
    every = [chr(i) for i in range(0x110000)]
    letter = np.fromiter(map(str.isalpha, every), dtype=bool, count=len(every))
    lower = np.arange(len(every), dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        small = every[i].lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return letter, lower


BASE = np.uint64(0x100000001B3)
BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


class Words:
    """Runs of letters of several texts in lower case, with hashes of any part.

    ``row`` is the text of each word, ``start`` and ``end`` its place in ``points``.
    """

    def __init__(self, texts: list[str]):
        letter, lower = letter_tables()
        points = code_points(["\n".join(texts)])[0]  # the line feed parts the words of two texts
        self.points = lower[points]
        inside = letter[points]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        last = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.row = np.searchsorted(last, self.start, side="right")
        power = np.full(len(points) + 1, BASE)
        power[0] = 1
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.points.astype(np.uint64) * np.cumprod(power)[:-1], dtype=np.uint64)))
        back = np.full(len(points) + 1, BASE_INVERSE)
        back[0] = 1
        self._back = np.cumprod(back)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the stretches of points, equal for equal stretches."""
        return mix64((self._sums[end] - self._sums[start]) * self._back[start])


def add_scores(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], column: str) -> DataFrame:
    """``docs`` with ``text`` replaced by a double ``column``; ``make`` is called
    in each task and gives a function from texts to scores."""
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            texts = text_column(b)
            out = np.zeros(len(texts))
            for lo, hi in pieces(texts):
                out[lo:hi] = fn(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out)], [*kept, column])

    return docs.mapInArrow(run, schema)


def collect_features(sample: DataFrame, features: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature ids, labels and ids of the rows (doc_id, text, y) of a bounded sample,
    in order of a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_column(b)
            for lo, hi in pieces(texts):
                row, ids = features(texts[lo:hi])
                offsets = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], b.column("y")[lo:hi], lists], ["doc_id", "y", "ids"])

    rows = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, ids array<int>")
    t = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    ids = t.column("ids").combine_chunks()
    values, offsets = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])], t.column("y").to_numpy(), t.column("doc_id").to_numpy()


def unique_pairs(row: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, id), sorted."""
    both = np.unique(row.astype(np.uint64) << np.uint64(bits) | ids)
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
