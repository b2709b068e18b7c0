import importlib
import re

import corpus_pipeline as cp

from .test_models import slow_base
from .test_shingle_dup import slow_labels

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.drop("_q")
    for name, stage in cp.STAGES:
        for given in (docs, no_docs.drop("_q")):
            out = stage(spark, given, SF)
            assert out.count() <= given.count(), name
            if name != cp.STAGES[-1][0]:
                assert out.columns == given.columns, name


def test_run_against_brute_force(spark):
    """Each stage on what the one before kept, with the plain definitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    out = cp.stored(cp.quality(spark, docs, SF), "t")
    kept = {r.doc_id for r in out.collect()}
    assert all(slow_base(rows[d])[0] >= 50 for d in kept) and out.columns == columns
    lines = cp.stored(cp.line_dedup(spark, out, SF), "t")
    assert {r.doc_id for r in lines.collect()} == kept
    texts = {r.doc_id: r.text or "" for r in lines.collect()}
    near = cp.stored(cp.near_dedup(spark, lines, SF), "t")
    order = sorted(texts)
    first = {order[i] for i in slow_labels([(d, texts[d]) for d in order])}
    assert {r.doc_id for r in near.collect()} == first
    clean = cp.stored(cp.decontamination(spark, near, SF), "t")
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {d for d in first if any(i in " ".join(re.findall(r"[^\W_]+", texts[d].lower())) for i in items)}
    assert {r.doc_id for r in clean.collect()} <= first - holds
    mixed = cp.mixing(spark, clean, SF).collect()
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, mixed))
    for s in {r.source for r in mixed}:
        mine = [r for r in mixed if r.source == s]
        assert sum(r.taken for r in mine) == round(mine[0].target)


def test_entry_lists_every_operator():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
