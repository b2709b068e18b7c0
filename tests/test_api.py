"""The corpus object: lookups, and SQL that can only be a query."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import model
from corpusloom.plans.api import Corpus


@pytest.fixture(scope="module")
def corpus(spark):
    tokens = spark.createDataFrame([(1, "g", 1, "The", "the", "the"), (1, "g", 2, "Cat", "cat", "cat"), (2, "g", 1, "Cats", "cat", "cats"), (3, "h", 1, "x", None, None)], "unit_id long, grp string, tok_no int, surface string, key string, subkey string")
    units = spark.createDataFrame([(1, "g", "The Cat"), (2, "g", "Cats"), (3, "h", "x"), (4, "h", "")], "unit_id long, grp string, text string")
    parts = spark.createDataFrame([(2, 1, 2, "s"), (2, 1, 1, "Cat")], "unit_id long, tok_no int, seg_no int, segment string")
    return Corpus(spark, tokens, units, parts)


def test_lookups(corpus):
    assert [tuple(r) for r in corpus.groups().collect()] == [("g", 2, 3), ("h", 2, 1)]
    assert [tuple(r) for r in corpus.group("h").collect()] == [("h", 2, 1)]
    assert [r.unit_id for r in corpus.units_of("g").collect()] == [1, 2]
    assert [r.surface for r in corpus.unit_with_tokens(1).collect()] == ["The", "Cat"]
    assert [r.surface for r in corpus.unit_with_tokens(4).collect()] == [None]
    assert [r.segment for r in corpus.token(2, 1).collect()] == ["Cat", "s"]
    assert [r.segment for r in corpus.token(1, 1).collect()] == [None]
    assert [(r.subkey, r.n) for r in corpus.key_with_subkeys("cat").collect()] == [("cat", 1), ("cats", 1)]


@pytest.mark.parametrize("text", ["CREATE OR REPLACE TEMP VIEW v AS SELECT 1", "DROP TABLE t", "INSERT INTO t VALUES (1)", "SET a = 1", "SELECT 1; DROP TABLE t", "SELECT 1) x; DROP TABLE t; SELECT * FROM (SELECT 1"])
def test_only_queries(corpus, text):
    with pytest.raises(ValueError):
        corpus.sql(text)


def test_query_with_parameters(corpus):
    assert corpus.sql("WITH a AS (SELECT * FROM {v_token}) SELECT count(*) AS n FROM a WHERE key = :k -- note", {"k": "cat"}).first().n == 2


def test_ranges_and_ordinals_of_large_groups(spark):
    """One range of ten million positions is a row per cell, never one array of positions."""
    ranges = spark.createDataFrame([("a", 1, 10_000_000), ("a", 5, 5), ("b", 4095, 4097)], "grp string, first long, last long")
    points = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9_999_999), ("a", 10_000_001), ("b", 4094), ("b", 4096), ("b", 4098)], "grp string, pos long")
    got = sorted((r.grp, r.pos, r.first) for r in model.in_range(points, ranges).collect())
    assert got == [("a", 1, 1), ("a", 5, 1), ("a", 5, 5), ("a", 9_999_999, 1), ("b", 4096, 4095)]
    left = model.in_range(points, ranges, "left")
    assert left.filter(F.col("first").isNull()).count() == 3
    offsets = model.group_offsets(spark.createDataFrame([("a", 10_000_000), ("b", 0), ("c", 3)], "grp string, size long"))
    ords = spark.createDataFrame([(1,), (10_000_000,), (10_000_001,), (10_000_003,), (10_000_004,)], "ord long")
    assert sorted((r.ord, r.grp, r.pos) for r in model.from_ordinal(ords, offsets).collect()) == [(1, "a", 1), (10_000_000, "a", 10_000_000), (10_000_001, "c", 1), (10_000_003, "c", 3)]
