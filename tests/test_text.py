"""Feature decoding, tokenisation repair, weighted edit distance."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import textops


def test_decode_features_rules(spark):
    rows = [
        ("P", "ACC|LEM:x"), ("N", "ACC|ROOT:r|MP"), ("P", "P|PREF"), ("N", "P|F"), ("P", "IMPV|PREF"), ("V", "PERF|3MS|VF:2|MOOD:JUS"), ("V", "PASS|IMPF|3D"), ("N", "NV|IMPV|INDEF|2FS"),
    ]
    df = tx.decode_features(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, cls string, feats string"), "cls", "feats")
    d = {r.i: r for r in df.collect()}
    assert (d[0].pos, d[0].case_mark, d[0].lemma) == ("ACC", None, "x")
    assert (d[1].pos, d[1].case_mark, d[1].root, d[1].gender, d[1].number, d[1].person) == ("N", "ACC", "r", "M", "P", None)
    assert (d[2].pos, d[2].number, d[2].role) == ("P", None, "prefix")
    assert (d[3].number, d[3].gender) == ("P", "F")
    assert (d[4].pos, d[4].aspect) == ("IMPV_LAM", None)
    assert (d[5].aspect, d[5].person, d[5].gender, d[5].number, d[5].verb_form, d[5].mood, d[5].voice) == ("PERF", 3, "M", "S", 2, "JUS", "ACT")
    assert (d[6].voice, d[6].person, d[6].number, d[6].gender) == ("PASS", 3, "D", None)
    assert (d[7].pos, d[7].aspect, d[7].state, d[7].voice) == ("NV", "IMPV", "INDEF", None)


def test_reconcile_tokens(spark):
    rows = [(1, ["a", "b"], 2), (2, ["ya", "b", "c"], 2), (3, ["x", "bad", "ma"], 2), (4, ["ya", "ibn", "um", "z"], 2), (5, ["p", "q", "r"], 2), (6, ["ya", "ya", "b"], 1)]
    df = spark.createDataFrame(rows, "i int, ws array<string>, n int")
    out = textops.reconcile_tokens(df, "ws", "n", ["ya"], [("bad", "ma")], [("ya", "ibn", "um")])
    got = {r.i: r.aligned for r in out.collect()}
    assert got == {1: ["a", "b"], 2: ["ya b", "c"], 3: ["x", "bad ma"], 4: ["ya ibn um", "z"], 5: None, 6: None}


def weak(a, b):
    w = set(tx.WEAK)
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        d[i][0] = i
    for j in range(len(b) + 1):
        d[0][j] = j
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            sub = 0 if x == y else 0.3 if x in w and y in w else 1
            d[i][j] = min(d[i - 1][j - 1] + sub, d[i - 1][j] + (0.5 if x in w else 1), d[i][j - 1] + (0.5 if y in w else 1))
    return round(d[-1][-1], 6)


def test_fuzzy_pairs_find_every_close_pair(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("بترسلاوي") for _ in range(rng.randrange(2, 6)))
    forms, keys = sorted({word() for _ in range(60)}), sorted({word() for _ in range(80)})
    f = spark.createDataFrame([(w,) for w in forms], "form string")
    k = spark.createDataFrame([(w, i) for i, w in enumerate(keys)], "key string, freq long")
    got = {(r.form, r.key): r.dist for r in textops.fuzzy_pairs(f, k, 1.0).collect()}
    assert got == {(a, b): weak(a, b) for a in forms for b in keys if weak(a, b) <= 1.0}
    best = {}
    for r in textops.nearest_keys(f, k).collect():
        best.setdefault(r.form, set()).add(r.key)
    for a in forms:
        low = min(weak(a, b) for b in keys)
        if low <= 1.6:
            assert best[a] == {b for b in keys if round(weak(a, b) - low, 6) <= 0.3}


def test_chunks_and_clauses(spark):
    text = " ".join(f"w{i}" + ("." if i % 50 == 49 else "") for i in range(1000))
    df = spark.createDataFrame([("a", text), ("b", "short one.")], "ref string, text string")
    out = tx.chunk_refs(df, "ref", "text").collect()
    a = [r for r in out if r.ref.startswith("a")]
    assert [r.ref for r in out if r.ref.startswith("b")] == ["b"]
    assert [len(r.text.split()) for r in a] == [300, 300, 300, 100]
    assert " ".join(r.text for r in a) == text
    c = spark.createDataFrame([("x y, z", 3), ("x, , y", 2), ("x y", 3)], "t string, n int")
    got = [r[0] for r in c.select(textops.clause_ranges(F.col("t"), F.col("n"), "[a-z]", ",")).collect()]
    assert [[tuple(p) for p in g] if g is not None else None for g in got] == [[(1, 2), (3, 3)], [(1, 1), (2, 2)], None]


def test_folded_words_are_the_folds_of_the_words(spark):
    texts = ["  Ein  Größe--\t-- naïve\r\n\nΣΟΦΟΣ œuvre İstanbul", "a b c\x0bd", "", "--", None, "Übunǵ x"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id int, s string")
    plain = F.transform(tx.words(F.col("s")), lambda w: F.struct(w.alias("surface"), tx.fold(w, "latin").alias("fold")))
    for r in df.select(tx.folded_words(F.col("s")).alias("got"), plain.alias("want")).collect():
        assert r.got == r.want


def test_document_tokens_are_folded_once(spark):
    """A filter on a folded column and two columns of it run the pattern once per text."""
    from corpusloom.plans import tables as tb

    t = tb.doc_tokens(spark, "/root/testdata/sf0.001").filter("key IS NOT NULL").select("key", "subkey")
    assert t._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_normalise_keeps_settled_texts_out_of_python(spark):
    import unicodedata

    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    joins = {unicodedata.normalize("NFD", c)[-1] for c in points if len(unicodedata.normalize("NFD", c)) > 1}
    sent = {r.c for r in spark.createDataFrame([(c,) for c in points], "c string").filter(F.col("c").rlike(tx.UNSETTLED)).collect()}
    assert not [c for c in points if c not in sent and (unicodedata.normalize("NFC", c) != c or unicodedata.combining(c) or c in joins)]
    assert not [c for c in map(chr, range(1, 0x300)) if c in sent]
    texts = ["\u2003 e\u0301t\u00e9 \x1c\x85", "  plain\n", "", None, "a" + " " * 50_000 + "b \n", "\u1100\u1161", "\u212b \u2000x", "\ufeffx "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.t for r in tx.normalise_columns(df, ["t"]).collect()}
    assert got == {i: t and unicodedata.normalize("NFC", t.strip()) for i, t in enumerate(texts)}


def test_usage_map_takes_the_next_token_without_a_join(spark):
    from corpusloom.plans import tables

    rows = tables.doc_tokens_with_next(spark, "/root/testdata/sf0.001")
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    tokens = tables.doc_tokens(spark, "/root/testdata/sf0.001")
    assert rows.count() == tokens.count()
    assert rows.filter("next_surface IS NULL").count() == tokens.select("unit_id").distinct().count()
