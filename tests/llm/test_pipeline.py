"""The pipeline on the smallest tables, each stage against its own input."""

from __future__ import annotations

import os

import corpus_pipeline as cp
from pyspark.sql import functions as F

from terragrain.llm import decontaminate, quality


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = cp.materialise(stage(spark, docs, data), "test-stage")
        seen[name] = (docs, out)
        if name != cp.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    before, after = seen["quality_classifier"]
    verdict = quality.judged(before, spark.read.parquet(f"{data}/labels.parquet"))
    assert after.count() == verdict.where("keep").count() < before.count()
    before, after = seen["benchmark_decontamination"]
    bad = decontaminate.overlaps(before, spark.read.parquet(f"{data}/benchmark.parquet")).select("doc_id").distinct()
    assert after.count() == before.count() - bad.count() and after.join(bad, "doc_id").count() == 0
    before, after = seen["source_mixing"]
    often = after.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert often <= 2 and after.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    before, after = seen["sharding"]
    assert after.count() == before.count()


def test_near_dedup_by_loop(spark, data):
    """The stage on the smallest table against all pairs of texts."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    want = {i for i in ids if top(i) == i}
    got = {r.doc_id for r in cp.near_dedup(spark, docs, data).collect()}
    assert got == want and len(want) < len(ids)


def test_run(spark, data):
    folder = os.path.join(spark.conf.get("spark.checkpoint.dir"), "terragrain")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = cp.run(spark, data)
    assert got.count() > 0 and {"doc_id", "shard", "slot"} <= set(got.columns)
    assert {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before} == {"stage-sharding", "slot-map"}


def test_empty(spark, no_docs, edge_docs, data):
    for docs in (no_docs.select("doc_id", "text", "lang", "source", "n_chars"), edge_docs):
        for _, stage in cp.STAGES:
            docs = cp.materialise(stage(spark, docs, data), "test-edge")
        docs.count()
