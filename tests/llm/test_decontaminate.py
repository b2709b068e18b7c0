import random
import re

from corpusloom.llm import decontaminate as dc

from .conftest import prose, with_clashes


def slow(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = {}
    for d, t in docs:
        w = words(t or "")
        for i, x in items:
            v = words(x or "")
            if len(v) < 5:
                continue
            for g in range(-len(v), len(w)):
                score = run = best = 0
                for k in range(max(0, -g), min(len(v), len(w) - g)):
                    same = v[k] == w[g + k]
                    score += 1 if same else -4
                    if score < 0:
                        score = run = 0
                    else:
                        run += same
                    best = max(best, run)
                if best >= min(13, -(-4 * len(v) // 5)):
                    out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_substitutions_and_partial_passages(spark):
    rng = random.Random(4)
    items = [(i, prose(100 + i, n)) for i, n in enumerate([5, 6, 8, 15, 20, 40, 60])] + [(90, "too short"), (None, prose(120, 20)), (91, None), (92, "")]
    docs = [(0, prose(50, 300)), (1, None), (2, "")]
    for k, (i, text) in enumerate(items[:7]):
        v = text.split()
        if len(v) >= 15:
            for j in range(7, len(v), 9):
                v[j] = "changed"
        docs.append((10 + k, prose(200 + k, 40) + " " + " ".join(v).upper() + ", " + prose(300 + k, rng.randint(0, 40))))
    docs += [(30, " ".join(items[5][1].split()[20:])), (31, items[5][1].split(" ", 25)[-1]), (None, items[4][1]), (32, items[4][1]), (32, items[4][1])]
    got = dc.contaminated(with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = slow(docs, items)
    assert {(r.doc_id, r.item_id): r.matched for r in got} == want
    assert {10 + k for k in range(7)} | {30, 32, None} <= {d for d, _ in want} and not {0, 1, 2} & {d for d, _ in want}


def test_same_without_broadcast(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (sorted(map(tuple, dc.contaminated(docs, bench, n).collect())) for n in (4_000_000, 0))
    assert a == b and a


def test_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, prose(11, 120)), (2, None), (3, "")], "item_id long, text string")
    kept = dc.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert dc.decontaminate(no_docs, bench).count() == 0
    assert dc.decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()
