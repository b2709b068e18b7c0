"""Steps whose time, memory or disk grew faster than their input."""

import itertools
import time

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import scale
from corpusloom.functions import text as tx
from corpusloom.operators import align, audit, pairs, textops
from corpusloom.operators import stats as st


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sides_are_found_once_per_row(spark):
    rows = spark.createDataFrame([("en", ["a", "b", "b"]), ("de", ["c"]), ("fr", [])], "tag string, items array<string>")
    each = st.items_by_side(rows.select("tag", F.filter("items", lambda x: x != "").alias("items")), [("l", "a"), ("r", "b"), ("r", "c")])
    assert sorted(map(tuple, each.collect())) == [("de", ["r"], "c"), ("en", ["l", "r"], "a"), ("en", ["l", "r"], "b"), ("en", ["l", "r"], "b")]
    plan = optimised(each)  # printed from the result down to the source
    assert "arrays_overlap" not in plan[: plan.index("Generate")] and "arrays_overlap" in plan


def test_longest_runs_of_a_batch():
    rng = np.random.default_rng(5)
    xs = [rng.integers(0, k, n) for k, n in [(3, 9), (2, 40), (50, 30), (1, 5), (4, 0), (9, 1), (3, 60)]]
    ys = [rng.integers(0, k, n) for k, n in [(3, 12), (2, 33), (50, 41), (1, 7), (4, 3), (9, 1), (3, 50)]]

    def plain(x, y):
        best = (0, 0)
        for i in range(len(x)):
            for j in range(len(y)):
                k = 0
                while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
                    k += 1
                best = (k, i) if k > best[0] else best
        return best

    want = [plain(x, y) for x, y in zip(xs, ys)]
    assert align.longest_runs(xs, ys) == want
    assert align.longest_runs(xs, ys, most=100) == want  # in parts, and by windows


def test_best_window_takes_whole_lanes():
    rng = np.random.default_rng(7)

    def plain(xs, xl):
        width, best = min(len(xl), len(xs) + 3), (-1, 0)
        for s in range(0, len(xl) + 2 - width + 1):
            if min(s + width, len(xl)) - s >= 4:
                best = max(best, (align.edit_path(xs, xl[s : s + width])[1], -s))
        return (-best[1], width, best[0]) if best[0] >= 4 else None

    for k in range(60):
        xs, xl = rng.integers(0, 2 + k % 9, 1 + k % 23), rng.integers(0, 2 + k % 9, 4 + k)
        assert align._best_window(xs, xl) == plain(xs, xl)
        assert align._best_window(xs, xl, room=1) == plain(xs, xl)
    start = time.perf_counter()
    assert align._best_window(rng.integers(0, 40, 300), rng.integers(0, 40, 1500))
    assert time.perf_counter() - start < 4  # one script per window took over 10 s


def test_runs_and_scripts_are_made_once(spark):
    row = ("u", "v", ["a", "b", "c", "d"], ["b", "c", "d", "a"])
    df = spark.createDataFrame([row], "a string, b string, a_seq array<string>, b_seq array<string>")
    runs = align.with_longest_run(df, "a_seq", "b_seq").filter("run >= 3")
    assert runs.select("run", "run_at").first() == (3, 1)
    assert optimised(runs).count("runs(") == 1
    out = align.op_counts(align.with_alignment(df.withColumns({"a_surf": F.col("a_seq"), "b_surf": F.col("b_seq")})), ["a", "b"])
    assert out.select("n_eq", "n_del", "n_ins", "moved").first() == (3, 1, 1, 1)
    assert optimised(out).count("align(") == 1  # no second script for the words that moved


def test_quotes_are_found_by_their_heads(spark):
    quotes = ["the cat sat on", "cat sat", "he cat sat on the mat", "\u0627\u0644 \u0643\u062a\u0627\u0628 \u0643", "no such words here"]
    texts = ["xthe cat sat on the mat", "", None, "cat sa", "a \u0627\u0644 \u0643\u062a\u0627\u0628 \u0643", "the cat sat on" * 3]
    long = [q for q in quotes if len(q) >= audit.HEAD]
    find = audit.finder(long)
    assert [sorted(find(t)) for t in texts] == [sorted(q for q in long if t and q in t) for t in texts]
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    u = spark.createDataFrame(list(enumerate(texts)), "unit_id long, text string")
    want = {(i, k) for i, q_ in enumerate(quotes) if len(q_) >= 8 for k, t in enumerate(texts) if t and q_ in t}
    for letters in (audit.PASS, 16):  # in one pass over the units, and in several
        assert {(r.quote_id, r.unit_id) for r in audit.link_quotations(q, u, lambda c: c, letters=letters).collect()} == want


def test_many_blocks_do_not_multiply_small_groups(spark):
    rows = [(g, (g * 13 + k * k * 7) % 4000) for g in range(60) for k in range(40)] + [(60, k) for k in range(300)]
    df = spark.createDataFrame(sorted(set(rows)), "g long, i long")
    got = {(r.a, r.b): r.n for r in scale.pairs_within(df, "g", "i", 64).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    want, groups = {}, {}
    for g, i in set(rows):
        groups.setdefault(g, []).append(i)
    for items in groups.values():
        for pair in itertools.combinations(sorted(items), 2):
            want[pair] = want.get(pair, 0) + 1
    assert got == want


def test_weak_distances_are_those_of_the_column(spark):
    rng = np.random.default_rng(3)
    letters = list(tx.WEAK + "\u0628\u062a\u062b")
    words = ["".join(rng.choice(letters, n)) for n in (0, 1, 2, 3, 5, 8, 4, 6)]
    both = [(x, y) for x in words for y in words]
    df = spark.createDataFrame(both, "a string, b string")
    want = [r.d for r in df.select(F.round(tx.weak_distance(F.col("a"), F.col("b")), 6).alias("d")).collect()]
    assert np.round(textops.weak_distances(*zip(*both)), 6).tolist() == want
    assert textops.weak_distances([], []).tolist() == []


def test_nearest_keys_compare_all_where_spellings_are_more(spark):
    keys = spark.createDataFrame([("\u0628\u062a\u062b" * n + x, n) for n in (1, 4, 12) for x in ("\u062c", "\u062d", "\u0648")], "key string, freq long")
    forms = spark.createDataFrame([("\u0628\u062a\u062b" * 12 + "\u062e\u062e\u062e\u062e",), ("\u0628\u062a\u062c",), (None,)], "form string")
    rows = {r.form: [] for r in forms.collect() if r.form}
    for r in textops.nearest_keys(forms, keys).orderBy("form", "rank").collect():
        rows[r.form].append((r.key, r.dist))
    every = [r.key for r in keys.collect()]
    for form, got in rows.items():
        dist = dict(zip(every, np.round(textops.weak_distances([form] * len(every), every), 6).tolist()))
        best = min(dist.values())
        assert dict(got) == {k: d for k, d in dist.items() if round(d - best, 6) <= 0.3}
    assert textops.nearest_keys(forms.filter("form IS NULL"), keys).count() == 0


def test_overlap_is_that_of_all_grams(spark):
    texts = {u: [str((u // 3 * 7 + k * k) % 11) for k in range(12)] + ["x", "y", "z", "v", "w"] + [str(u % 2)] * 4 for u in range(12)}
    seqs = spark.createDataFrame([(u, s, f"d{u}") for u, s in texts.items()], "unit_id long, seq array<string>, digest string")
    grams = {u: {tuple(s[i : i + 4]) for i in range(len(s) - 3)} for u, s in texts.items()}
    held = {}
    for g in itertools.chain(*grams.values()):
        held[g] = held.get(g, 0) + 1
    want = {}
    for a, b in itertools.combinations(texts, 2):
        shared = sum(2 <= held[g] <= 3 for g in grams[a] & grams[b])
        if shared >= 2:
            want[a, b] = (shared, len(grams[a] & grams[b]) / len(grams[a] | grams[b]))
    assert want and max(held.values()) > 3
    for floor in (0.0, 0.9):
        got = {(r.a, r.b): (r.shared, r.jac) for r in pairs.overlapping_pairs(seqs, "digest", floor=floor, high=3).collect()}
        assert got == {k: v for k, v in want.items() if v[1] >= floor}
