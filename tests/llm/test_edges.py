"""Each operator over awkward rows, and over none at all."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from terragrain.llm import decontaminate, exact_dedup, langid, licenses, mixing, quality, secrets, sharding, simhash, toxicity


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact(edge_docs, no_docs, edge_rows):
    got = exact_dedup.exact_groups(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by = {}
    for r in edge_rows:
        by.setdefault(lower_az(r[1]), []).append(r[0])
    shas = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by.items()}
    for r in got:
        ids = shas[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
        assert r.kept == (r.doc_id == r.keep_id if known else True)
    assert exact_dedup.exact_groups(no_docs).count() == 0


def counts_of(hashes):
    def counts(depth, above, prefixes):
        out = {}
        for h in hashes:
            if prefixes is None or h >> (64 - above) in prefixes:
                out[h >> (64 - depth)] = out.get(h >> (64 - depth), 0) + 1
        return out

    return counts


def test_directory():
    rng = random.Random(1)
    close = [(5 << 59) + k for k in range(300)]  # alike in all but their last bits
    hashes = sorted({rng.getrandbits(64) for _ in range(2000)} | set(close))
    d = exact_dedup.Directory.build(counts_of(hashes), 100, 4)
    ends = [p << (64 - k) for p, k in d.buckets]
    assert ends == sorted(ends) and d.depth > 50 and sum(2.0**-k for _, k in d.buckets) == 1
    for p, k in d.buckets:
        assert sum(h >> (64 - k) == p for h in hashes) <= 100
    assert exact_dedup.Directory.build(counts_of([7] * 50), 10, 3).depth == 64
    assert exact_dedup.Directory.build(counts_of([]), 10, 1).buckets == [(0, 0)]


def test_small_buckets(spark, edge_docs):
    docs = spark.createDataFrame([(i, f"Text {i % 300}") for i in range(900)], "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, bucket_rows=4).collect()
    assert len(got) == 900 and all(r.group_size == 3 and r.keep_id == r.doc_id % 300 + 600 and r.kept == (r.doc_id >= 600) for r in got)


def test_sharding(edge_docs, no_docs, edge_rows):
    got = sharding.shard(edge_docs, 3).collect()
    assert len(got) == len(edge_rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in edge_rows)
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(no_docs).count() == 0


def test_mixing(edge_docs, no_docs, edge_rows):
    got = mixing.mix(edge_docs).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        assert r.taken <= 2 * r["size"]
    out = mixing.mixed(edge_docs)
    assert out.columns == edge_docs.columns and out.count() > 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_simhash(edge_docs, no_docs, edge_rows):
    got = simhash.linked_components(edge_docs).collect()
    assert len(got) == len(edge_rows)
    empty = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert empty == {1}
    assert len({r.component_id for r in got if r.doc_id in (10, 11)}) == 1
    out = simhash.without_near_copies(edge_docs)
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in out.collect())
    assert out.columns == edge_docs.columns and ids == [-1, 1, 4, 6, 7, 8, 9, 10]
    assert simhash.linked_components(no_docs).count() == 0 and simhash.without_near_copies(no_docs).count() == 0


def test_decontamination(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "One two THREE four five six, seven eight nine ten eleven twelve", 3), (2, "short", 3), (3, None, 3), (None, "", 3), (1, "One two THREE four five six, seven eight nine ten eleven twelve", 3)], "item_id long, text string, h int")
    got = decontaminate.overlaps(edge_docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(4, 1), (5, 1)]
    out = decontaminate.decontaminated(edge_docs, bench)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count() - 3
    assert decontaminate.overlaps(no_docs, bench).count() == 0
    assert decontaminate.overlaps(edge_docs, bench.limit(0)).count() == 0


def test_quality(edge_docs, no_docs, edge_labels, no_labels):
    got = quality.judged(edge_docs, edge_labels).collect()
    assert len(got) == edge_docs.count()
    assert not any(r.keep for r in got if r.bits is None) and sum(r.bits is None for r in got) == 3
    out = quality.good_documents(edge_docs, no_labels)
    assert out.columns == edge_docs.columns and {r.doc_id for r in out.collect()} >= {3, 4, 5, 6, None}
    assert quality.good_documents(no_docs, edge_labels).count() == 0


def test_langid(edge_docs, no_docs):
    model = langid.train(edge_docs)
    got = langid.predict(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.predict(edge_docs, langid.train(no_docs)).collect()} == {"und"}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)


def test_secrets(edge_docs, no_docs):
    got = {r.doc_id: r for r in secrets.scan(edge_docs).collect()}
    r = got[8]
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1) and r.spans == "assign:0:25,access:26:46,hex:47:79"
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(no_docs).count() == 0


def test_licenses(edge_docs, no_docs):
    got = licenses.notices(edge_docs).collect()
    assert sorted((r.doc_id, r.line, r.license) for r in got) == [(9, 0, "MIT"), (9, 1, "MIT")]
    assert licenses.notices(no_docs).count() == 0


def test_toxicity(edge_docs, no_docs, edge_labels, no_labels):
    for labels in (edge_labels, no_labels):
        model = toxicity.train(edge_docs, labels)
        got = toxicity.score(edge_docs, model).collect()
        assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(no_docs, model).count() == 0


def test_fold_reads_ids_as_text(edge_docs):
    rows = edge_docs.select("doc_id", langid.crc_mod(F.col("doc_id"), 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 for r in rows)


def test_ties(edge_docs, edge_rows):
    """Languages of equal score: the first in order. A score of one half counts as toxic."""
    blank = langid.Model(["aa", "bb"], np.zeros((langid.FEATURES, 2), np.float32), np.zeros(2), 1.0)
    got = langid.predict(edge_docs, blank).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("aa", 0.5), ("und", 0.0)}
    even = toxicity.Model(toxicity.Automaton([]), np.zeros(0), frozenset(), frozenset(), np.zeros(toxicity.FEATURES), 0.0)
    assert {(r.score, r.predicted) for r in toxicity.score(edge_docs, even).collect()} == {(0.5, 1)}


def test_summary_of_licences(edge_docs, no_docs, edge_rows):
    got = licenses.summary(edge_docs).collect()
    assert len(got) == len(edge_rows) and {r.doc_id: r.n_notices for r in got if r.n_notices} == {9: 2}
    assert licenses.summary(no_docs).count() == 0
