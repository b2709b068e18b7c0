import re
from itertools import combinations

from corpusloom.llm import decontaminate as dc

from .conftest import prose


def slow(docs, items):
    """The most equal words of any stretch of a diagonal that is four fifths equal, by all stretches."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            need = len(v) if len(v) < 5 else min(13, -(-4 * len(v) // 5))
            for g in range(-len(v), len(w)):
                same = [v[k] == w[g + k] for k in range(max(0, -g), min(len(v), len(w) - g))]
                if sum(same) < need:
                    continue
                best = max([sum(same[a:b]) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 5 * sum(same[a:b]) >= 4 * (b - a)], default=0)
                if best >= need:
                    out[d, i] = max(best, out.get((d, i), 0))
    return out


def compare(spark, items, docs):
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = slow(docs, items)
    assert {(r.doc_id, r.item_id): r.matched for r in got.collect()} == want
    return want


def planted(lengths, most):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in lengths]
    docs = []
    for n, x in items:
        for k in range(0, most + 1):
            for at in list(combinations(range(n), k))[:: 1 if n < 12 else 7]:
                v = x.split()
                for p in at:
                    v[p] = "changed"
                docs.append((len(docs), f"{prose(len(docs), 3)} {' '.join(v)} {prose(n, 3)}"))
    return items, docs


def test_substitutions_at_every_position(spark):
    want = compare(spark, *planted([10, 12, 14, 15, 16, 17, 30], 2))
    assert len({d for d, _ in want}) > 100


def test_short_items(spark):
    items, docs = planted([1, 2, 3, 4, 5, 6, 7, 8, 9], 1)
    want = compare(spark, items, [*docs, (9000, "i5w0 i5w1 i5w2 i5w3"), (9001, "i9w1 i9w2 i9w3 i9w4 i9w5 i9w6 i9w7 i9w8 x")])
    assert {(9000, 5), (9001, 9)} <= set(want) and len(want) == 9 + sum(range(5, 10)) + 2
