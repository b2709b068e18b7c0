"""Rules, spans, agreement, schedules and stream jobs on small hand-made inputs."""

import datetime as dt

from pyspark.sql import functions as F

from corpusloom.functions.scale import scratch_path
from corpusloom.operators import evaluate as ev
from corpusloom.operators import sequence as q
from corpusloom.streaming import streams as st


def test_clause_gates(spark):
    words = [
        (1, 1, "no x rock"), (1, 1, "Bob all"), (1, 1, "then all"), (1, 1, "all"), (1, 2, "all 7"), (1, 2, "all"), (1, 3, "no him rock"),
    ]
    toks, clauses, at = [], [], {}
    for g, p, c in words:
        n, k = at.get((g, p), (0, 0))
        ws = c.split()
        toks += [(g, p, n + i + 1, w) for i, w in enumerate(ws)]
        clauses.append((g, p, k + 1, n + 1, n + len(ws)))
        at[(g, p)] = (n + len(ws), k + 1)
    t = spark.createDataFrame(toks, "grp int, pos int, tok_no int, w string")
    c = spark.createDataFrame(clauses, "grp int, pos int, clause int, first int, last int")
    w = F.col("w")
    out = q.clause_gates(t, c, [q.Rule("all", w == "all"), q.Rule("none", w == "no", w == "rock", 3, w == "him")], [q.Rule("name", w == "Bob")], [q.Rule("num", w == "7")], w == "then")
    got = {(r.pos, r.clause): (r.gates, r.blockers, r.qualified) for r in out.collect()}
    assert got == {
        (1, 1): (["none"], [], True), (1, 2): (["all"], ["name"], False), (1, 3): (["all"], ["name"], False), (1, 4): (["all"], [], True),
        (2, 1): (["all"], ["num"], False), (2, 2): (["all"], ["num"], False), (3, 1): ([], [], False),
    }


def test_kappa_and_spans(spark):
    rows = [(True, True)] * 20 + [(True, False)] * 5 + [(False, True)] * 10 + [(False, False)] * 15
    k = ev.kappa(spark.createDataFrame(rows, "x boolean, y boolean"), "x", "y").first()
    assert abs(k.kappa - 0.4) < 1e-9
    units = spark.createDataFrame([(1, i) for i in range(1, 9)] + [(2, 1)], "grp int, pos int")
    spans = q.spans_from_boundaries(units, spark.createDataFrame([(1, 3)], "grp int, pos int"))
    assert sorted((r.grp, r["first"], r["last"]) for r in spans.collect()) == [(1, 1, 3), (1, 4, 8), (2, 1, 1)]


def fold(grades):
    ease, interval, lapses = 2.3, 0.0, 0
    for g in grades:
        interval = st._next_interval(interval, g, round(ease, 9))
        ease = max(1.3, ease + {0: -0.2, 1: -0.15, 3: 0.1}.get(g, 0.0))
        lapses += g == 0
    return round(ease, 6), interval, lapses


def test_repetition_state_equals_one_by_one(spark):
    hist = {1: [0, 2, 3, 1], 2: [0] * 9 + [2, 2, 2, 3, 1], 3: [3, 3, 3, 2, 0, 1, 1, 1, 2], 4: [1] * 12}
    rows = [(k, i, i * 1000, g) for k, gs in hist.items() for i, g in enumerate(gs)]
    df = spark.createDataFrame(rows, "key long, seq long, ms long, grade int")
    got = {r.key: (round(r.ease, 6), r.interval, r.lapses) for r in st.repetition_state(df).collect()}
    assert got == {k: fold(g) for k, g in hist.items()}
    folder = scratch_path(spark, "grades")
    df.coalesce(1).write.parquet(folder)
    stream = st.repetition_stream(spark.readStream.schema(df.schema).parquet(folder))
    run = stream.writeStream.format("memory").queryName("rep").outputMode("append").trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "ck")).start()
    run.awaitTermination()
    assert {r.key: (round(r.ease, 6), r.interval, r.lapses) for r in spark.table("rep").collect()} == got


def test_request_rate(spark):
    base = dt.datetime(2024, 1, 1)
    secs = [0, 1, 2, 59, 60, 61, 200]
    df = spark.createDataFrame([("a", base + dt.timedelta(seconds=s)) for s in secs], "caller string, ts timestamp")
    got = sorted((r.ts, r.recent) for r in st.request_rate(df, 60, 3).collect())
    assert [n for _, n in got] == [1, 2, 3, 4, 4, 4, 1]
    folder = scratch_path(spark, "rate")
    df.coalesce(1).write.parquet(folder)
    s = st.request_rate_stream(spark.readStream.schema(df.schema).parquet(folder), 60, 3)
    run = s.writeStream.format("memory").queryName("rate").outputMode("append").trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "ck")).start()
    run.awaitTermination()
    assert sorted((r.ts, r.recent, r.limited) for r in spark.table("rate").collect()) == [(t, n, n > 3) for t, n in got]


def test_request_rate_over_batches(spark):
    """A burst that straddles batches is counted whole, a late request within its own window."""
    base = dt.datetime(2024, 1, 1)
    folder = scratch_path(spark, "rate")
    kind = "caller string, ts timestamp"
    for secs in ([0, 50, 55], [58, 59, 70], [65]):
        spark.createDataFrame([("a", base + dt.timedelta(seconds=s)) for s in secs], kind).coalesce(1).write.mode("append").parquet(folder)
    import glob
    import os

    for k, f in enumerate(sorted(glob.glob(f"{folder.removeprefix('file:')}/*.parquet"), key=os.path.getmtime)):
        os.utime(f, (k + 1, k + 1))  # one file a batch, in the order written
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    run = st.request_rate_stream(stream, 60, 3).writeStream.format("memory").queryName("rate2").outputMode("append").trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "ck")).start()
    run.awaitTermination()
    got = {(r.ts - base).seconds: r.recent for r in spark.table("rate2").collect()}
    assert got == {0: 1, 50: 2, 55: 3, 58: 4, 59: 5, 70: 5, 65: 5}


def test_callers_expire_and_late_requests_count(spark):
    """Once the watermark has passed its window a caller leaves the state; what comes behind the watermark is dropped."""
    base = dt.datetime(2024, 1, 1)
    folder, out, ck = (scratch_path(spark, n) for n in ("rate", "rates", "ck"))
    kind = "caller string, ts timestamp"
    held = lambda: {r.key[0] for r in spark.read.format("statestore").option("stateVarName", "times").load(ck).select("key").collect()}
    parts = [[("gone", 0), ("gone", 10), ("stays", 30)], [("stays", 500), ("stays", 20)], [("stays", 510)], [("stays", 5)], [("stays", 4000), ("gone", 4000)]]
    seen = []
    for rows in parts:
        spark.createDataFrame([(c, base + dt.timedelta(seconds=s)) for c, s in rows], kind).write.mode("append").parquet(folder)
        st.run_to_table(st.request_rate_stream(spark.readStream.schema(kind).parquet(folder), 60, 1, "120 seconds"), out, ck)
        seen.append(held())
    got = {(r.caller, (r.ts - base).seconds): (r.recent, r.limited) for r in spark.read.parquet(out).collect()}
    assert got == {("gone", 0): (1, False), ("gone", 10): (2, True), ("stays", 30): (1, False), ("stays", 20): (1, False), ("stays", 500): (1, False), ("stays", 510): (2, True), ("stays", 4000): (1, False), ("gone", 4000): (1, False)}
    assert seen[0] == {"gone", "stays"} and "gone" not in seen[2] and seen[-1] == {"gone", "stays"}


def test_schedules_live_for_their_days(spark):
    folder, out, ck = (scratch_path(spark, n) for n in ("grades", "cards", "ck"))
    kind = "key long, seq long, ms long, grade int"
    hist = {1: [2, 2, 2], 2: [0, 3, 1]}
    for i in range(3):
        spark.createDataFrame([(k, i, i * 1000, g[i]) for k, g in hist.items()], kind).write.mode("append").parquet(folder)
        st.run_to_table(st.repetition_stream(spark.readStream.schema(kind).parquet(folder), days=30), out, ck)
    got = {r.key: (round(r.ease, 6), r.interval, r.lapses, r.reps) for r in st.latest_cards(spark.read.parquet(out)).collect()}
    assert got == {k: (*fold(g), 3) for k, g in hist.items()}


def test_upsert_keeps_the_last_write(spark):
    from corpusloom.sources.sinks import upsert

    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, at long, v string")
    new = spark.createDataFrame([(2, 3, "new"), (2, 2, "z"), (3, 1, "c"), (3, 1, "d")], "k long, at long, v string")
    want = [(1, 1, "a"), (2, 3, "new"), (3, 1, "d")]
    once = upsert(old, new, ["k"], ["at"])
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, upsert(once, new, ["k"], ["at"]).collect())) == want
