import random
from fractions import Fraction

import pytest

from corpusloom.llm import line_templates as lt
from corpusloom.llm import mixture as mx
from corpusloom.llm.queries import OP9_SQL
from tools import check_queries as cq

from .conftest import prose, with_clashes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op9_same_as_sql(spark, sf):
    state, note, _ = cq.compare(spark, cq.connect(sf), "op9_line_template_dedup", sf)
    assert state == "OK" and OP9_SQL, note


def test_templates_generalise_fields(spark):
    docs = [(i, f"{prose(i, 30)}\nPage {i} of {i + 3} served by host{i} in total\nPosted today by {prose(i + 50, 1)} on the daily board for all readers today\n\n{prose(i + 90, 12)}") for i in range(8)]
    docs.append((100, docs[0][1]))
    out = {r.doc_id: r for r in lt.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0].text == docs[0][1] and out[0].n_dropped == 0  # the first keeps its lines
    assert out[100].n_dropped == 2
    for i in range(1, 8):
        first, _, _, blank, last = docs[i][1].split("\n")
        assert out[i].text == "\n".join([first, blank, last]) and out[i].n_lines == 4
    every = {r.doc_id: r for r in lt.drop_lines(spark.createDataFrame(docs, "doc_id long, text string"), keep_first=False).collect()}
    assert every[0].n_dropped == 2


def test_copies_of_a_document_are_one(spark):
    docs = [(i, "the same document\nwith the same lines") for i in range(20)]
    assert all(r.n_dropped == 0 for r in lt.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_odd_documents(odd_docs, no_docs):
    out = lt.drop_lines(odd_docs)
    assert set(out.columns) == set(odd_docs.columns) and out.count() == odd_docs.count()
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in odd_docs.collect())
    assert lt.drop_lines(no_docs).count() == 0


def levels(sizes):
    """Resharing done step by step, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    free, aim, left = set(order), {}, Fraction(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            aim |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            aim[s] = Fraction(3 * sizes[s])
            left -= aim[s]
        free -= over
    return aim


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: int(10 ** rng.uniform(0, 4)) for s in [*"abcdefghij", None, "é"]}
    sizes["b"] = 0
    got = mx.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = levels(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == {s: float(t) for s, t in want.items()}


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, i % 40), "abc"[i % 3] if i % 7 else "d") for i in range(300)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = mx.mix(docs, block=16).collect()
    again = mx.mix(docs, block=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == 300
    size = {i: len(t.split()) for i, t, _ in rows}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in out)
    source = {i: s for i, _, s in rows}
    for s in "abcd":
        mine = [r for r in out if source[r.doc_id] == s]
        assert {r.source_size for r in mine} == {sum(r.size for r in mine)}
        assert sum(r.taken for r in mine) == round(mine[0].target)


def test_schedule_is_low_discrepancy(spark):
    aims = spark.createDataFrame([(1, 6000.0), (2, 3000.0), (3, 1000.0), (4, 0.0)], "sid long, target double")
    slots = sorted((r.slot, r.sid) for r in mx.schedule(aims, 10).collect())
    assert [sum(1 for _, s in slots if s == k) for k in (1, 2, 3, 4)] == [600, 300, 100, 0]
    for n in (50, 333, 700):
        early = [s for _, s in slots[:n]]
        assert all(abs(early.count(k) - n * share) <= 5 for k, share in ((1, 0.6), (2, 0.3), (3, 0.1)))


def test_odd_mix(odd_docs, no_docs):
    out = mx.mix(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r.size == 0 and r.taken == 0 for r in out if r.doc_id in (3, 4, 5))
    docs = mx.mixed_documents(odd_docs)
    assert set(docs.columns) >= set(odd_docs.columns) and docs.filter("doc_id = 6").count() == 1
    assert mx.mix(no_docs).count() == 0 and mx.mixed_documents(no_docs).count() == 0


def test_mix_ends_in_a_short_plan(spark):
    """The driver holds one step at a time, not the plan of all of them."""
    docs = spark.createDataFrame([(i, "a b c " * (i + 1), "s" + str(i % 3)) for i in range(30)], "doc_id long, text string, source string")
    plan = mx.mix(docs, block=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6
