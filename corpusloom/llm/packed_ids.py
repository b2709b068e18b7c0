"""Token ids in files of fixed-width bit packing, written and read by Spark.

``spark.write.format("packed_ids")`` stores rows (doc_id, ids) in their order,
each id in the fewest bits that hold the vocabulary; ``spark.read`` gives (doc_id,
start, ids) back, ``start`` counting the ids of all documents before.

A file is ``PKID``, the blocks, the index and a trailer of fixed size.  A block
holds ``BLOCK`` ids (the last fewer) from a whole byte on, lowest bit first, so
that any stretch of ids is read by its blocks alone and unpacked by numpy.  The
index holds the offsets of all blocks, the ids of the documents, which of them
are null, and the number of ids before each document.  All numbers are little
endian.

Every write task makes files of its own name, and the commit lists those of the
tasks that ended in ``manifest.json``: what a lost executor or a repeated task
leaves behind is never read.  A task holds one batch of rows, one block and the
index of its file.

Defined results: a null text is empty and holds the end id alone; a null doc_id
comes first and stays null; documents of one id are ordered by the hash of
their text, equal rows stay.  An empty table gives a manifest without files and
an empty result.  Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusloom.functions.scale import shuffle_width
from corpusloom.llm.common import pieces, text_column, text_key, text_of

MAGIC = b"PKID"
BLOCK = 4096  # ids; a multiple of 8, so that a block ends with a whole byte
TRAILER = struct.Struct("<QQQHI4s")  # place of the index, documents, ids, bits, ids of a block, PKID
SPLIT = 1 << 24  # ids of a read task
BATCH = 1 << 20  # ids of a batch of rows
PIECE = 1 << 22  # characters encoded together
#: Latin letters of one code point in either case, all but U+0130 up to U+024F, and ASCII marks behind them.
LATIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-/:-@\[-`{-~]*)").fullmatch


def width(vocabulary: int) -> int:
    """Bits that hold the ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (local, hdfs, s3 or what else pyarrow opens) and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class PackedFile:
    """Writes one file: documents one after the other, then the index."""

    def __init__(self, out: pa.NativeFile, bits: int):
        self.out, self.bits, self.at, self.offsets = out, bits, len(MAGIC), []
        self.rest = np.zeros(0, np.uint32)
        self.doc_ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.at)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        if len(ids) and (ids.min() < 0 or int(ids.max()) >> self.bits):
            raise ValueError(f"an id does not fit in {self.bits} bits")
        self.doc_ids.append(doc_ids)
        self.lengths.append(lengths.astype(np.int64))
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) - len(ids) % BLOCK
        for lo in range(0, whole, BLOCK):
            self._block(ids[lo : lo + BLOCK])
        self.rest = ids[whole:].copy()

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        if len(self.rest):
            self._block(self.rest)
        known = pa.chunked_array(self.doc_ids, pa.int64())
        before = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.lengths]))])
        index = self.at
        self.out.write(np.array([*self.offsets, self.at], dtype="<i8").tobytes())
        self.out.write(known.fill_null(0).to_numpy().astype("<i8").tobytes())
        self.out.write(known.is_null().to_numpy().astype(np.uint8).tobytes())
        self.out.write(before.astype("<i8").tobytes())
        self.out.write(TRAILER.pack(index, len(known), int(before[-1]), self.bits, BLOCK, MAGIC))
        return len(known), int(before[-1])


class PackedReader:
    """Reads any documents or ids of one file without the rest of it."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        size = file.size()
        self.index, self.n_docs, self.n_ids, self.bits, self.block, magic = TRAILER.unpack(self._bytes(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        self.blocks = -(-self.n_ids // self.block)

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _numbers(self, at: int, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self._bytes(at + 8 * lo, 8 * (hi - lo)), dtype="<i8")

    def documents(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of documents lo to hi, which of them are null, and the ids before each and before hi."""
        at = self.index + 8 * (self.blocks + 1)
        null = np.frombuffer(self._bytes(at + 8 * self.n_docs + lo, hi - lo), dtype=np.uint8).astype(bool)
        return self._numbers(at, lo, hi), null, self._numbers(at + 9 * self.n_docs, lo, hi + 1)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Token ids lo to hi of the file."""
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, -(-hi // self.block)
        offsets = self._numbers(self.index, first, last + 1)
        n = min(self.n_ids, last * self.block) - first * self.block
        return unpack(self._bytes(int(offsets[0]), int(offsets[-1] - offsets[0])), n, self.bits)[lo - first * self.block : hi - first * self.block]


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    documents: int
    ids: int


@dataclass
class Stretch(InputPartition):
    """Documents lo to hi of a file, which begins at id ``start`` of the whole."""

    file: str
    lo: int
    hi: int
    start: int


class IdWriter(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = place(self.path)
        store.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.ids"
        with store.open_output_stream(f"{folder}/{name}") as out:
            file = PackedFile(out, self.bits)
            for b in iterator:
                lists = b.column("ids")
                file.add(b.column("doc_id"), lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            documents, ids = file.close()
        return Written(TaskContext.get().partitionId(), name, documents, ids)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = place(self.path)
        store.create_dir(folder, recursive=True)
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        listed = [{"file": m.file, "documents": m.documents, "ids": m.ids} for m in parts]
        with store.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"bits": self.bits, "parts": listed}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = place(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{folder}/{m.file}")


def manifest(path: str) -> list[dict]:
    """The files in order, each with the number of ids before it."""
    store, folder = place(path)
    with store.open_input_file(f"{folder}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    start = 0
    for p in parts:
        p["start"] = start
        start += p["ids"]
    return parts


class IdReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Stretch]:
        out = []
        for p in manifest(self.path):
            cuts = np.linspace(0, p["documents"], -(-p["ids"] // self.split) + 1).astype(int).tolist()
            out += [Stretch(p["file"], lo, hi, p["start"]) for lo, hi in zip(cuts[:-1], cuts[1:]) if lo < hi]
        return out or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, folder = place(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as f:
            file = PackedReader(f)
            doc_ids, null, before = file.documents(partition.lo, partition.hi)
            lo = 0
            while lo < len(doc_ids):
                hi = max(lo + 1, int(np.searchsorted(before, before[lo] + BATCH, side="right")) - 1)
                ids = file.ids(int(before[lo]), int(before[hi])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array((before[lo : hi + 1] - before[lo]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[lo:hi], mask=null[lo:hi]), pa.array(before[lo:hi] + partition.start), lists], ["doc_id", "start", "ids"])
                lo = hi


class PackedIds(DataSource):
    """Options: ``path``; to write ``bits``; to read ``split``, the ids of a task."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "doc_id long, start long, ids array<int>"

    def reader(self, schema) -> IdReader:  # noqa: ANN001
        return IdReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> IdWriter:  # noqa: ANN001
        return IdWriter(self.options["path"], int(self.options["bits"]))


class WordEncoder:
    """Ids of texts by a tokenizer that never joins or looks across white space:
    every distinct word is encoded once while it stays in the table.  A table of
    more than ``limit`` words keeps those that came in two batches or more.

    With ``letters`` the work is less: it encodes texts of Latin letters and
    spaces alone, and ``last`` marks the ids that end a word, so that many words
    are encoded as one text and parted after these ids; a word of such letters
    with marks behind it has the ids of both.
    """

    def __init__(self, encode, letters=None, last: np.ndarray | None = None, limit: int = 400_000):  # noqa: ANN001
        self.encode, self.letters, self.last, self.limit = encode, letters, last, limit
        self._start([], np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _start(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.known = dict(zip(words, range(len(words))))
        self.ids, self.ends = ids, np.concatenate([[0], np.cumsum(n)])
        self.seen = np.zeros(len(words), np.int32)

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.seen > 1)
        if len(kept) > self.limit // 2:
            kept = kept[:0]
        words = list(self.known)
        n = np.diff(self.ends)
        at = np.repeat(self.ends[kept] - (np.cumsum(n[kept]) - n[kept]), n[kept]) + np.arange(int(n[kept].sum()))
        self._start([words[i] for i in kept.tolist()], self.ids[at], n[kept])

    def _learn(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int32)])

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words one after another, and where each ends."""
        n = self.ends[at + 1] - self.ends[at]
        total = np.cumsum(n)
        return self.ids[np.repeat(self.ends[at] - total + n, n) + np.arange(int(total[-1]) if len(total) else 0)], total

    def _add(self, words: list[str]) -> None:
        if self.letters:
            plain, tailed, stems, marks, rest = {}, [], [], [], []
            for w in words:
                m = LATIN(w)
                if m is None:
                    rest.append(w)
                elif m[2]:
                    tailed.append(w), stems.append(m[1]), marks.append(m[2])
                else:
                    plain[w] = None
            plain.update(dict.fromkeys(s for s in stems if s not in self.known))
            if plain:
                plain = list(plain)
                ids, _ = self.letters([" ".join(plain[i : i + 256]) for i in range(0, len(plain), 256)])
                self._learn(plain, ids, np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0))
            if tailed:
                new = list(set(marks).difference(self.known))
                self._learn(new, *self.encode(new))
                both = np.fromiter(map(self.known.__getitem__, chain.from_iterable(zip(stems, marks))), dtype=np.int64, count=2 * len(tailed))
                ids, ends = self._ids(both)
                self._learn(tailed, ids, np.diff(ends[1::2], prepend=0))
            words = [w for w in rest if w not in self.known]
        if words:
            self._learn(words, *self.encode(words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > self.limit:
            self._shrink()
        self._add([w for w in distinct if w not in self.known])
        place = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        self.seen[place] += 1
        ids, total = self._ids(place[words.indices.to_numpy()])
        ends = np.concatenate([[0], total])[lists.offsets.to_numpy()[1:]]
        return ids, np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool):
    """A function from texts to (ids, number of ids of each).  A Python worker
    keeps it, with the words it has learned, for its next tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer, pre_tokenizers

    def ids_by(tokenizer: Tokenizer):
        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lists = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(lists), dtype=np.int32), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))

        return encode

    tokenizer = Tokenizer.from_file(path)
    whole = ids_by(tokenizer)
    if not by_word:
        return whole
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix or tokenizer.normalizer is None or tokenizer.normalizer.normalize_str("Az") != "az":
        return WordEncoder(whole)
    # of lower-case Latin letters nothing is left to normalise, and white space alone parts them
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    letters = ids_by(bare)
    last = np.array([tokenizer.id_to_token(i).endswith(suffix) for i in range(tokenizer.get_vocab_size())])
    return WordEncoder(whole, lambda texts: letters([t.lower() for t in texts]), last)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def encode_documents(docs: DataFrame, path: str, end_id: int, by_word: bool = False) -> DataFrame:
    """(doc_id, ids) in ascending order over the partitions: the ids of each whole
    text and ``end_id``.

    ``by_word`` says that the tokenizer at ``path`` encodes a text word by word,
    white space parting words; the ids are the same, found with less work.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), text_key().alias("key"))
    n = max(shuffle_width(docs.sparkSession), docs.sparkSession.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(path, by_word)
        for b in batches:
            texts = text_column(b)
            for lo, hi in pieces(texts, PIECE):
                ids, n = make(texts[lo:hi])
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + np.arange(1, len(n) + 1)]).astype(np.int32)), pa.array(np.insert(ids, ends, end_id).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], lists], ["doc_id", "ids"])

    return ordered.mapInArrow(run, "doc_id long, ids array<int>")


def write_ids(encoded: DataFrame, path: str, vocabulary: int) -> None:
    encoded.sparkSession.dataSource.register(PackedIds)
    encoded.write.format("packed_ids").option("path", path).option("bits", width(vocabulary)).mode("append").save()


def read_ids(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(doc_id, start, ids) of every document."""
    spark.dataSource.register(PackedIds)
    return spark.read.format("packed_ids").option("path", path).option("split", split).load()


def window(path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from id ``start`` of the whole on, reading their blocks only."""
    store, folder = place(path)
    out = [np.zeros(0, np.uint32)]
    for p in manifest(path):
        lo, hi = max(start, p["start"]), min(start + count, p["start"] + p["ids"])
        if lo < hi:
            with store.open_input_file(f"{folder}/{p['file']}") as f:
                out.append(PackedReader(f).ids(lo - p["start"], hi - p["start"]))
    return np.concatenate(out)


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum is that of the ids as
    little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy()
            data = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(data[lo:hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
