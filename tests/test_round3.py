"""Work that grew faster than its input, beside the plain forms of the same results."""

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import audit, pairs
from corpusloom.operators import model as m
from corpusloom.operators import stats as st
from corpusloom.operators import vectors as v
from corpusloom.plans import graph_queries as gq
from corpusloom.plans import model_queries as mq
from corpusloom.plans import tables as tb


def written(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_norm_and_scale_are_taken_once_per_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert written(df.select(v.normalise("v").alias("u"))).count("aggregate(") == 1
    assert written(df.select(v.quantise("v").alias("q"))).count("array_max(") == 2  # the peak itself and the test for zero
    rows = df.select(v.normalise("v"), v.quantise("v").alias("q")).collect()
    assert [r[0] for r in rows] == [[0.6, 0.8], [0.0, 0.0], None]
    assert [r.q.q for r in rows] == [[95, 127], [0, 0], None]


def test_central_nodes_search_neighbours_once(spark, monkeypatch):
    calls, real = [], v.knn
    monkeypatch.setattr(v, "knn", lambda *a, **k: calls.append(1) or real(*a, **k))
    gq.g05(spark, "/root/testdata/sf0.001").agg(F.count("*")).collect()
    assert len(calls) == 1


def exchanged(df):
    """Columns by which the rows of a plan are dealt."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


UNITS = [(1, "en", ["that", "with", "river", "river"]), (2, "de", ["that", "stein", "river"]), (3, "fr", ["with", "pont"]), (4, "en", []), (5, "en", None), (6, None, ["from", "river", "stone"])]


def as_rows(spark):
    return spark.createDataFrame(UNITS, "unit_id long, tag string, items array<string>")


def as_tokens(spark):
    return as_rows(spark).select("unit_id", "tag", F.explode("items").alias("subkey"))


def same(a, b):
    assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect())) != []


def test_collocates_in_rows_equal_those_of_tokens(spark):
    seeds = [("a", "that"), ("a", "none"), ("b", "with"), ("b", "from")]
    rows = st.collocates_in_rows(as_rows(spark).select("tag", "items"), seeds, ["fr"])
    same(rows, st.collocates(as_tokens(spark), spark.createDataFrame(seeds, "side string, subkey string"), ["unit_id"], ["fr"]))


def test_document_frequency_in_rows_shuffles_no_units(spark):
    tokens = as_tokens(spark).withColumnRenamed("subkey", "key")
    rows = st.document_frequency_in_rows(as_rows(spark))
    same(rows, st.document_frequency(tokens, ["unit_id"]))
    assert not any("unit_id" in x for x in exchanged(rows))


def test_partners_in_rows_equal_those_of_tokens(spark):
    tokens = as_tokens(spark).withColumnRenamed("subkey", "key")
    same(pairs.partners_in_rows(as_rows(spark), "that", 1, 10), pairs.partners(tokens, "that", 1, 10))


def test_text_search_equals_the_scan_of_all_postings(spark):
    asked = [(1, "that"), (1, "river"), (2, "with"), (3, "river"), (3, "absent"), (4, "river")]
    q = spark.createDataFrame(asked, "qid long, term string")
    t = as_tokens(spark).withColumnRenamed("subkey", "term")
    post = t.groupBy("term", "unit_id").agg(F.count(F.lit(1)).alias("tf"))
    lens = t.groupBy("unit_id").agg(F.count(F.lit(1)).alias("len"))
    for k in (1, 5):
        same(audit.text_search(q, as_rows(spark), k), audit.full_text_search(q, post, lens, k))


def test_folds_are_the_folds_of_the_words_without_empty_ones(spark):
    df = spark.createDataFrame([("  Éa b1\t--  ß\r\nX ",), ("",), (None,), ("- -",)], "text string")
    for words, folds in df.select(tx.folded_words(F.col("text")), tx.folds(F.col("text"))).collect():
        assert folds == (None if words is None else [w.fold for w in words if w.fold])


def test_concordance_makes_words_of_the_first_documents_only(spark, monkeypatch):
    given, real = [], tb.doc_tokens
    monkeypatch.setattr(tb, "doc_tokens", lambda s, sf, only=None: given.append(only) or real(s, sf, only))
    found = mq.r39(spark, "/root/testdata/sf0.001")
    assert given[0] is not None and given[0].count() == found.select("unit_id").distinct().count() <= 40
    same(found, m.concordance(real(spark, "/root/testdata/sf0.001"), "that", "that", ["unit_id"], 40))
