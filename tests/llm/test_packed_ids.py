"""Packed ids: exact round trips, and the query beside the plain tokenizer."""

import json
import os
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packed_ids as K
from corpusloom.llm import queries

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, (1 << b) - 1), max_size=200))))
@settings(max_examples=200, deadline=None)
def test_pack_and_unpack(case):
    bits, ids = case
    data = K.pack(np.array(ids, dtype=np.uint32), bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert K.unpack(data, len(ids), bits).tolist() == ids


def test_width():
    assert [K.width(v) for v in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("bits", [5, 13, 16, 17])
def test_round_trip_through_spark(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(None if i == 0 else i, [int(x) for x in rng.integers(0, 1 << bits, size=n)]) for i, n in enumerate([3, 0, 9000, 1, 4096, 0, 4095, 50])]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    K.write_ids(df, f"file:{path}/x", 1 << bits)
    got = sorted((r.start, r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in K.read_ids(spark, f"{path}/x", split=2000).collect())
    start, want = 0, []
    for i, ids in rows:
        want.append((start, i is not None, i or 0, ids))
        start += len(ids)
    assert got == sorted(want)
    every = [x for _, ids in rows for x in ids]
    for a, n in ((0, 10), (4000, 9000), (start - 1, 5), (9, 0)):
        assert K.window(f"{path}/x", a, n).tolist() == every[a : a + n]
    with open(f"{path}/x/manifest.json") as f:
        assert sum(p["ids"] for p in json.load(f)["parts"]) == start


def test_files_of_lost_tasks_are_not_read(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/x"
    K.write_ids(spark.createDataFrame([(1, [1, 2])], "doc_id long, ids array<int>"), path, 8)
    with open(f"{path}/part-left-behind.ids", "wb") as f:
        f.write(b"half a fi")
    assert [(r.doc_id, list(r.ids)) for r in K.read_ids(spark, path).collect()] == [(1, [1, 2])]


def test_too_large_ids_are_refused(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/x"
    with pytest.raises(Exception, match="does not fit"):
        K.write_ids(spark.createDataFrame([(1, [8])], "doc_id long, ids array<int>"), path, 8)
    assert not os.path.exists(f"{path}/manifest.json")


texts = st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t\x0b\x85  .,'stdléÉßİΣ́̊"))), max_size=40), min_size=1, max_size=5)


@given(texts)
@settings(max_examples=300, deadline=None)
def test_word_by_word_is_the_whole_text(texts):
    fast, plain = ENCODERS
    (a, n), (b, m) = fast(texts), plain(texts)
    assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


ENCODERS = (K.encoder(VOCABULARY, True), K.encoder(VOCABULARY, False))


@pytest.mark.parametrize("limit", [3, 8])
def test_table_of_words_is_bounded(limit):
    words = K.WordEncoder(ENCODERS[1], ENCODERS[0].letters, ENCODERS[0].last, limit=limit)
    for text in ("one two three four", "five, two one", "", "seven 8 nine's", "two ten", "two eleven. twelve, eleven, . , three! two. \u00e9. x.. .x It's. <|endoftext|> <|endoftext|>.", "a b c d e f two"):
        assert words([text, text])[0].tolist() == ENCODERS[1]([text, text])[0].tolist()
        assert len(words.known) <= limit + 22
    assert limit == 3 or "two" in words.known


def slow_digests(rows):
    t, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_tokenizer(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op13(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == slow_digests((r.doc_id, r.text) for r in docs)


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/x"
        K.write_ids(K.encode_documents(docs, VOCABULARY, 2, True), path, K.vocabulary_size(VOCABULARY))
        got = sorted((tuple(r) for r in K.digests(K.read_ids(spark, path)).collect()), key=lambda r: r[1])
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        order = [(g[0], g[2]) for g in got]
        assert [i for i, _ in order] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
        assert sorted(g[3] for g in got) == sorted(s[3] for s in slow_digests(texts))
        assert [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got]])[:-1].tolist() if got else True
