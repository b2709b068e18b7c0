import math

from corpusloom.llm import quality_rules

from .conftest import prose


def test_no_gram_is_cut_and_both_ways_agree(spark, odd_docs):
    """A small language beside a large one is scored as it is alone, by both ways."""
    small = [(i, "xx", prose(900 + i, 80).replace("e", "\u00f8")) for i in range(12)]
    large = [(100 + i, "en", prose(i, 400)) for i in range(200)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, lang string, text string")
    of = lambda docs, n: {r.doc_id: r._q.perplexity for r in quality_rules.judge(docs, broadcast_grams=n).collect()}
    alone, beside, joined = of(table(small), 4_000_000), of(table(small + large), 4_000_000), of(table(small + large), 0)
    assert all(math.isclose(alone[i], beside[i], rel_tol=1e-6) for i, _, _ in small)
    assert all(math.isclose(beside[i], joined[i], rel_tol=1e-6) for i in beside)
    odd = odd_docs.drop("_q")
    a, b = (sorted(((str(r.doc_id), r.text or "", r._q.perplexity or 0, r._q.kept) for r in quality_rules.judge(odd, broadcast_grams=n).collect())) for n in (4_000_000, 0))
    assert len(a) == len(b) and all(x[:2] == y[:2] and x[3] == y[3] and math.isclose(x[2], y[2], rel_tol=1e-6) for x, y in zip(a, b))


def test_kept_orders_are_whole(spark):
    docs = spark.createDataFrame([(i, "en", prose(i, 300)) for i in range(20)], "doc_id long, lang string, text string")
    want = len({("\0" * 4 + t)[k : k + 5] for (t,) in docs.select("text").collect() for k in range(len(t))})
    model = quality_rules.build_model(docs, {"en": 1}, 50)
    assert len(model.grams[-1][0]) == want > 50
