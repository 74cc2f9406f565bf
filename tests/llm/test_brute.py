"""Each operator against a plain loop, an exact round trip or held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import frames_equal
from pyspark.sql import functions as F

from terragrain.llm import decontaminate, langid, licenses, mixing, quality, registry, secrets, sharding, simhash, toxicity
from terragrain.llm.components import components


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(name, spark, data, duck):
    frames_equal(registry.QUERIES[name](spark, data).toPandas(), duck.sql(registry.ORACLES[name]).df())


# 1: decontamination


def test_substitutions_within_windows(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    bench = [[rng.choice(vocab) for _ in range(n)] for n in (1, 4, 5, 6, 8, 8, 11, 12, 13, 18, 24, 30)]
    docs = []
    for n in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        if n % 2:
            part = list(rng.choice(bench))
            for k in rng.sample(range(len(part)), min(len(part), n % 7)):
                part[k] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = part
        docs.append(words)
    want = {}
    for d, t in enumerate(docs):
        for b, item in enumerate(bench):
            if len(item) < decontaminate.SHORTEST:
                continue
            span = min(decontaminate.SPAN, len(item))
            most = decontaminate.mismatches(span)
            starts = {i for i in range(len(t) - span + 1) for j in range(len(item) - span + 1) if sum(x != y for x, y in zip(t[i : i + span], item[j : j + span])) <= most}
            if starts:
                want[d, b] = len(starts)
    got = decontaminate.overlaps(
        spark.createDataFrame([(i, " ".join(t).upper() + ".") for i, t in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(i, ", ".join(t)) for i, t in enumerate(bench)], "item_id long, text string"),
    )
    assert {(r.doc_id, r.item_id): r.windows for r in got.collect()} == want and any(len(bench[b]) < 12 for _, b in want)
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(bench)] + [(99, " ".join(bench[-1]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminated(frame, items).collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_shuffled_join_gives_the_same(spark, data, monkeypatch):
    a = registry.QUERIES["op1_decontamination"](spark, data).toPandas()
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    frames_equal(registry.QUERIES["op1_decontamination"](spark, data).toPandas(), a)


# 2: quality


def kneser_ney(codes, order, size):
    """Interpolated modified Kneser-Ney probabilities by dictionaries; a function of an n-gram."""
    counts = {order: Counter()}
    for seq in codes:
        for i in range(order - 1, len(seq)):
            counts[order][tuple(seq[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        return [max(0.0, min(i, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 for i in (1, 2, 3)]

    d = {k: discounts(c) for k, c in counts.items()}

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / size
        same = {x: v for x, v in counts[k].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return lower
        cut = lambda v: d[k][min(v, 3) - 1]
        return max(0.0, same.get(g, 0) - (cut(same[g]) if g in same else 0)) / total + sum(map(cut, same.values())) / total * lower

    return p


def plain_symbols(text):
    return [quality.CAPITAL if c.isupper() else quality.DIGIT if c.isdigit() else 0xE000 + ord(c) % 0x1900 if ord(c) > 0xFFFF else max(ord(c), quality.FIRST) for c in text]


def test_costs_are_kneser_ney(spark, monkeypatch):
    """The cost of every text, by dictionaries, in several chunks, with symbols that training has not seen."""
    texts = ["abra cadabra abra", "banana bandana", "a cab a dab a nab", "Drab 12 crab", "привет, мир", "\U0001f600 cab"]
    more = ["abra banana", "", None, "x", "мир и crab 7", "zebra " * 300, "\U0001f600\U0001f601", "\x00\x01\x02 a"]
    model = quality.Model(spark.createDataFrame([(t,) for t in texts], "text string"))
    codes = [[32] * 3 + plain_symbols(t) for t in texts]
    size = len({c for x in codes for c in x[3:]}) + 1
    assert model.size == size
    p = kneser_ney(codes, quality.ORDER, size)
    docs = spark.createDataFrame(list(enumerate([*texts, *more])), "doc_id long, text string")
    for dense, chunk, parts in ((1 << 24, 8_000_000, 50_000), (1, 300, 50_000), (1 << 24, 100, 2)):
        monkeypatch.setattr(quality, "DENSE", dense)
        monkeypatch.setattr(quality, "PARTS", parts)
        monkeypatch.setattr(quality, "CHUNK", chunk)
        got = {r.doc_id: r for r in quality.costs(docs, model, ["doc_id"]).collect()}
        assert len(got) == len(texts) + len(more)
        for i, t in enumerate([*texts, *more]):
            if not t:
                assert got[i].bits is None and got[i].chars == 0
                continue
            code = [32] * 3 + plain_symbols(t)
            bits = [-math.log2(p(tuple(code[k - 3 : k + 1]))) for k in range(3, len(code))]
            assert got[i].bits == pytest.approx(sum(bits) / len(bits), rel=1e-6)  # costs are held in single precision


def test_texts_travel_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    plan = quality.costs(docs, quality.Model(docs.limit(20)), ["doc_id"])
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_quality_follows_labels(spark, data):
    got = registry.QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    assert got[got.quality == 1].keep.mean() > 0.97 and got[got.quality == 0].keep.mean() < 0.1


# 3: mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            open_.remove(s)
        left -= sum(out[s] for s in full)
    return out


def test_targets(spark):
    rng = random.Random(1)
    for sizes in ({"b": 100, "a": 100, None: 100, "c": 1000}, {}, {None: 5}, {f"s{i}": rng.choice([0, 1, 30, 500, 9000]) for i in range(40)} | {"\U0001f600": 7, "\uffff": 70}):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: r.target for r in got} == pytest.approx(plain_targets(sizes))


def test_fit_reaches_what_can_be_reached():
    rng = random.Random(9)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 40), 4))
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 150)
        sums = {0}
        for n, k in zip(lengths, counts):
            sums = {s + n * m for s in sums for m in range(k + 1)}
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= k for t, k in zip(take, counts))
        got = sum(n * t for n, t in zip(lengths, take))
        assert abs(got - budget) == min(abs(s - budget) for s in sums)


def test_large_budgets_are_met():
    lengths, counts = list(range(1, 3000)), [5] * 2999
    for share in (0.1, 0.5, 0.93):
        budget = int(sum(n * 5 for n in lengths) * share)
        assert sum(n * t for n, t in zip(lengths, mixing.fit(lengths, counts, budget))) == budget


def test_long_documents_are_fitted():
    lengths = list(range(15_838, 21_838, 2))
    for budget, want in ((24_576, 21_836), (100_001, 100_000), (3, 0), (10_000, 15_838)):
        take = mixing.fit(lengths, [3] * len(lengths), budget)
        assert sum(n * t for n, t in zip(lengths, take)) == want and all(0 <= t <= 3 for t in take)


def test_windows_are_widened():
    """Multiples of seven and two documents of eight words, far apart in a first window that is too small."""
    for budget in (7 * 5000 + 2, 7 * 5000 + 1, 7 * 5000 + 4):
        take = mixing.fit([7, 8], [10_000, 2], budget, window=64)
        assert abs(7 * take[0] + 8 * take[1] - budget) == min(abs(7 * k + 8 * m - budget) for k in range(4990, 5010) for m in range(3))


def test_mixed_takes_what_mix_says(spark):
    rng = random.Random(12)
    rows = [(None if i % 5 == 0 else 3 if i % 5 == 1 else i, " ".join(["w"] * rng.randint(0, 9) + [str(i % 11)]), rng.choice(["a", "b", None]), i) for i in range(400)] + [(7, "same text here", "a", -1)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h long")
    got, out = mixing.mix(docs).toPandas(), mixing.mixed(docs).toPandas()
    assert len(got) == len(rows) and list(out.columns) == docs.columns
    for source, g in got.groupby("source", dropna=False):
        mine = out[out.source.isna()] if source is None or source != source else out[out.source == source]
        assert mine.text.str.split().str.len().sum() == g.taken.sum() and abs(g.taken.sum() - g.target.iloc[0]) <= 0.5 and (g.taken <= 2 * g["size"]).all()


def test_mix(spark, data):
    got = registry.QUERIES["op3_mixing"](spark, data).toPandas()
    again = registry.QUERIES["op3_mixing"](spark, data).toPandas()
    frames_equal(got, again)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    assert all(r.size == sizes[r.doc_id] for r in got.itertuples(name="R"))
    for source, g in got.groupby("source"):
        target = g.target.iloc[0]
        assert g.source_size.iloc[0] == g["size"].sum() and abs(g.taken.sum() - target) <= max(2, 0.02 * target)
        assert (g.taken <= 2 * g["size"]).all()


def test_hot_length_is_ranked_in_parts(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 2900, "a").otherwise("b").alias("source"))
    whole = mixing.mix(docs).toPandas()
    monkeypatch.setattr(mixing, "RANKED", 100)
    parts = mixing.mix(docs).toPandas()
    for got in (whole, parts):
        for _, g in got.groupby("source"):
            assert abs(g.taken.sum() - g.target.iloc[0]) <= 3


# 4: SimHash


def plain_fingerprint(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(n, linked):
    at = list(range(n))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in linked:
        at[root(a)] = root(b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("bucket", [32, 1])
def test_simhash_components(spark, data, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = simhash.linked_components(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert all(int(r.fingerprint, 16) == fp[r.doc_id] for r in got.itertuples())
    ids = sorted(fp)
    root = groups(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(fp[ids[a]] ^ fp[ids[b]]).count("1") <= 2])
    least = {}
    for k, i in enumerate(ids):
        least[root[k]] = min(least.get(root[k], i), i)
    assert {r.doc_id: r.component_id for r in got.itertuples()} == {i: least[root[k]] for k, i in enumerate(ids)}


def test_crowded_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(120)} | {base[0] & ~(2**42 - 1) | rng.getrandbits(42) for _ in range(200)})
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, f0 long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, k, *a: frame)
    monkeypatch.setattr(simhash, "BUCKET", 4)
    got = simhash.linked_components(frame).toPandas()
    root = groups(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2])
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert {r.doc_id: r.component_id for r in got.itertuples()} == {i: least[r] for i, r in enumerate(root)}


def test_components_raise_rather_than_end_early(spark):
    with pytest.raises(RuntimeError, match="settle"):
        components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), most_rounds=1)


@pytest.mark.parametrize("per_task", [100_000, 20])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr("terragrain.llm.components.PER_TASK", per_task)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = groups(1100, edges)
    least = {}
    for x in range(1100):
        least.setdefault(root[x], x)
    assert got == {x: least[root[x]] for e in edges for x in e if x != least[root[x]]}


def test_near_copies_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, n = [], 0
    for group in range(40):
        base = [word() for _ in range(rng.randint(120, 400))]
        for m in range(3):
            copy = list(base)
            for k in rng.sample(range(len(copy)), m and len(copy) // 60):
                copy[k] = word()
            docs.append((n, " ".join(copy), group))
            n += 1
    kept = simhash.without_near_copies(spark.createDataFrame(docs, "doc_id long, text string, grp int")).toPandas()
    assert sorted(kept.grp) == list(range(40))


@pytest.mark.parametrize("block", [256, 2])
def test_full_buckets_lose_no_near_copy(spark, monkeypatch, block):
    """One bucket that holds every text, with pairs of near copies that are far from its hub."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "ACROSS", block)
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: np.zeros((len(hashes), simhash.BANDS), "<u8"))
    rng = random.Random(3)
    docs = []
    for i in range(40):
        base = [str(rng.random()) for _ in range(200)]
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:-2], "other", "end"]))]
    got = simhash.near_rows(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["__tg_id"], r.keep["__tg_id"]) for r in got} == {(2 * i + 1, 2 * i) for i in range(40)}


def test_recall_at_the_threshold(spark):
    """300 pairs of similarity 0.80 to 0.85 and as many of 0.5 to 0.7, in one table."""
    rng = random.Random(17)
    docs, want, apart = [], 0, 0
    for i in range(600):
        base = [str(rng.random()) for _ in range(240)]
        n = rng.randint(214, 220) if i % 2 else rng.randint(163, 196)
        other = base[:n] + [str(rng.random()) for _ in range(240 - n)]
        j = (n - 4) / (2 * 236 - (n - 4))
        assert (0.8 <= j <= 0.86) if i % 2 else (0.5 <= j <= 0.7)
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    gone = {r["__tg_id"] for r in simhash.near_rows(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want, apart = sum(4 * i + 3 in gone for i in range(300)), sum(4 * i + 1 in gone for i in range(300))
    assert want >= 298 and apart == 0


def test_near_copies_without_ids(spark):
    """Null ids and repeated ids are judged row by row; rows alike in id and text stay together."""
    base = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(200))
    docs = spark.createDataFrame([(None, a), (None, a), (7, b), (5, a), (5, c), (None, c), (None, "one two"), (None, "one two"), (None, "ONE  two")], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.without_near_copies(docs).collect())
    assert [x for x in kept if x[0]] == [(5, c), (5, a)] and len({t for i, t in kept if not i}) == 1 and {t.lower().split()[0] for i, t in kept if not i} == {"one"}


def test_pivots_discard(spark, data):
    r = simhash.pivot_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).first()
    assert r.pairs == r.by_pivots + r.by_bits + r.links


def test_near_copies_are_exact(spark, monkeypatch):
    """Texts with a common passage of 65 to 95 % of their words: whatever is linked has shingle sets of similarity 0.8."""
    rng = random.Random(11)
    docs = []
    for group in range(12):
        base = [str(rng.random()) for _ in range(300)]
        for m in range(8):
            n = rng.randint(195, 297)
            docs.append((len(docs), " ".join(base[:n] + [str(rng.random()) for _ in range(300 - n)])))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    root = groups(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    want = {i: least[r] for i, r in enumerate(root) if i != least[r]}
    assert 12 < len(want) < 84
    got = simhash.near_rows(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["__tg_id"]: r.keep["__tg_id"] for r in got} == want


# 5: language


def test_language_held_out(spark):
    got = registry.QUERIES["op5_langid"](spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 200 and (held.lang_pred == held.lang).mean() > 0.99


def plain_cells(text):
    """Counter of the hashed cells of all n-grams of one to three characters that start within two blanks and the text."""
    x = [32, 32] + [(ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 32 for c in text] + [32, 32]
    out, m = Counter(), 2**32
    for i in range(len(text) + 2):
        h = 0
        for k in range(3):
            h = (h ^ x[i + k]) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[k] % m
            h ^= h >> 15
            out[(h * 0x27D4EB2F % m) >> 16] += 1
    return out


def test_language_by_loop(spark):
    """Document frequencies, calibrated scores and predictions of the query's steps, by dictionaries."""
    rng = random.Random(2)
    words = {"en": "the of and to in is was".split(), "fr": "le la des et dans été où".split(), "ru": "и в не на что".split()}
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choices(words[lang], k=rng.randint(1, 60))), None if i % 13 == 0 else lang) for i, lang in ((i, rng.choice(list(words))) for i in range(240))]
    rows += [(1000, "12 !?", "en"), (1001, "", None), (None, "les dans", "fr"), (7, "the was", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    allowed = [t for i, t, lang in rows if lang is not None and t is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2]
    df, n = langid.frequencies(docs)
    want = Counter(c for t in allowed for c in plain_cells(t))
    assert n == len(allowed) and {c: int(v) for c, v in enumerate(df) if v} == {c: sum(c in x for x in map(plain_cells, allowed)) for c in want}
    model = langid.train(docs)
    assert model.langs == ["en", "fr", "ru"] and (model.weights == 0).mean() > 0.9
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred, r.score))
    for i, t, _ in rows:
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
        if not any(c.isalpha() for c in t or ""):
            assert (held, "und", 0.0) in by[i]
            continue
        cells = plain_cells(t)
        z = [(sum(n * float(model.weights[c, j]) for c, n in cells.items()) / sum(cells.values()) + model.bias[j]) / model.temperature for j in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        best = max(range(3), key=lambda j: e[j])
        assert any(h == held and p == model.langs[best] and s == pytest.approx(e[best] / sum(e), abs=1e-4) for h, p, s in by[i])


def test_rare_languages_and_late_passages_are_learned(spark, monkeypatch):
    """A language of one row in five hundred, and texts whose language shows only after 2,500 digits."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 200)
    rng = random.Random(3)
    text = lambda words: "1" * 2500 + " " + " ".join(rng.choices(words.split(), k=300))
    rows = [(i, text("the and of to in was with"), "en") for i in range(3000)] + [(5000 + i, text("og det er en ikke var med"), "da") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs.where("doc_id % 100 = 0 or doc_id >= 5000"), langid.train(docs)).collect()
    assert {("da" if r.doc_id >= 5000 else "en", r.lang_pred) for r in got} == {("en", "en"), ("da", "da")}


# 7: sharding


def test_rebalance_and_versions(spark, tmp_path):
    rng = random.Random(3)
    weight = [rng.randrange(1000) for _ in range(512)]
    first = sharding.SlotMap.initial(8, 512)
    second = first.rebalance(weight)
    load = second.loads(weight)
    assert max(load) - min(load) <= 2 and second.version == 1
    third = second.rebalance(weight, 9)
    load = third.loads(weight)
    assert max(load) - min(load) <= 2
    for m in (first, second, third):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == second
    heavy = first.rebalance([10_000 if s == 5 else 1 for s in range(512)])
    assert heavy.shards[5] == first.shards[5]


def test_shards_are_even(spark, data):
    got = registry.QUERIES["op7_sharding"](spark, data).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() <= 0.01 * load.mean()


def test_shards_by_loop(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None if i % 7 == 0 else i // 2, None if i % 11 == 0 else "é" * rng.randint(0, 400)) for i in range(600)] + [(5, "same")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 3, 64, str(tmp_path / "map")).collect()

    def hashed(*values):
        seed = 42
        for v in values:
            if v is not None:
                seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
        return seed

    sizes = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    slot = {r: (hashed(*r) - (1 << 64) * (hashed(*r) >> 63)) % 64 for r in sizes}
    weight = [0] * 64
    for r in sizes:
        weight[slot[r]] += r[1]
    want = sharding.SlotMap.initial(3, 64).rebalance(weight)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.virtual_slot, r.law, r.grown_shard) for r in got) == Counter((*r, want.shards[slot[r]], slot[r], "bytes", None) for r in sizes)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(want.shards[slot[r]] == s for r in sizes)))
    again = sharding.shard(docs, 3, 64, str(tmp_path / "map")).collect()
    assert {r.map_version for r in again} == {2} and Counter((r.doc_id, r.text_crc32, r.shard) for r in again) == Counter((r.doc_id, r.text_crc32, r.shard) for r in got)


# 8: licences


def test_licences_by_loop(spark):
    lines = ["Released under the MIT license", "Licensed under the Apache License Version 2.0", "released under mit", "This work is licensed under the GNU General Public License, version 3.", "of the license of the license of the license"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    grams = lambda t: Counter(zip(w := licenses._plain(t).split(), w[1:]))
    want = set()
    for i, x in enumerate(lines):
        for t, (_, y) in enumerate(licenses.TEMPLATES):
            a, b = grams(x), grams(y)
            if a and 2 * sum((a & b).values()) >= licenses.THRESHOLD * (sum(a.values()) + sum(b.values())):
                want.add((i, t))
    assert {(r.doc_id, r.template) for r in licenses.notices(docs).collect()} == want and len(want) >= 3


def test_wrapped_and_embedded_notices(spark):
    text = {name: y for name, y in licenses.TEMPLATES}
    words = text["MIT"].split()
    wrapped = "A title\n" + "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11)) + "\nand what follows\n"
    inside = "Some words about the project come first. " * 9 + "It is Released under the MIT License. " + "More words come after that. " * 9
    docs = [(0, wrapped), (1, inside), (2, inside + inside), (3, wrapped + "Released under the MIT License.\n"), (4, "of the license and under the " * 30)]
    got = licenses.notices(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = sorted((r.doc_id, r.license, r.line, 2 * r.overlap / (r.line_size + r.template_size)) for r in got)
    assert found == [(0, "MIT", 1, 1.0), (1, "MIT", 0, 1.0), (2, "MIT", 0, 1.0), (2, "MIT", 0, 1.0), (3, "MIT", 1, 1.0), (3, "MIT", len(wrapped.splitlines()), 1.0)]


def test_whole_licences_with_changes(spark):
    docs = []
    for n, (name, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        if len(words) > 80:
            words[10] = "changed"
            del words[40]
            docs.append((n, "\n".join(["Copyright 2020 Somebody", *(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)), "and then more"])))
    got = licenses.summary(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_notices, r.license) for r in got} == {n: (1, licenses.TEMPLATES[n][0]) for n, _ in docs} and len(got) >= 5 and all(r.dice > 0.9 for r in got)


def test_rows_without_ids_have_notices(spark):
    docs = spark.createDataFrame([(None, "Released under the MIT License."), (None, "nothing"), (1, "Released under the MIT License."), (None, None), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_notices, r.license) for r in licenses.summary(docs).collect())
    assert got == [(0, 0, ""), (0, 0, ""), (0, 1, "MIT"), (1, 1, "MIT"), (2, 0, "")]


def test_anchors_lose_no_match():
    anchors = {*licenses.anchors()}
    for _, text in licenses.TEMPLATES:
        words = licenses._plain(text).split()
        found = {w for w in words if w in anchors or any(len(a) > 4 and a in w for a in anchors)}
        left = [(a, b) for a, b in zip(words, words[1:]) if not {a, b} & found]
        assert len(left) < licenses.bounds(len(words) - 1)[0]


# 9: secrets


def plain_spans(text):
    out = []
    for k, (_, pattern, group, least) in enumerate(secrets.BASE):
        wide = pattern.replace("{32,}", "+")
        out += [(m.start(), k, m.end()) for m in re.finditer(wide, text) if len(m[group]) >= least]
    base = list(out)
    for m in re.finditer(secrets.CANDIDATE, text):
        v = m[0]
        if not (re.search("[0-9]", v) and re.search("[A-Za-z]", v)) or any(a in v.lower() for a in secrets.ALLOWED):
            continue
        cls = secrets.HEX if re.fullmatch("[0-9a-fA-F]+", v) else secrets.BASE64
        best = max(-sum(n / 20 * math.log2(n / 20) for n in Counter(v[i : i + 20]).values()) for i in range(len(v) - 19))
        if best >= cls.bits - 1e-9 and not any(s <= m.start() and e >= m.end() for s, _, e in base):
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets_by_loop(spark):
    rng = random.Random(6)
    rand = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    b64, hexa = secrets.BASE64.members, "0123456789abcdef"
    texts = [
        "token: secret: abcdefghij", "PassWord='abc' passwd=\"longenough1\"", "éé api_key = " + rand(b64, 30), "AKIA" + rand("ABC123", 11) + " AKIA" + rand("ABC123", 12), rand(hexa, 31) + " " + rand(hexa, 33),
        "x" * 30 + "1", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "example" + rand(b64, 30), "SECRETTOKEN=12345678SECRET=87654321", *[rand(b64 + "   \n=:\"'é", 300) for _ in range(40)], *[rand(hexa + "  ", 200) for _ in range(20)],
    ]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t), t


def test_long_candidates_and_many_matches(spark):
    """A candidate of a megabyte and a text of ten thousand matches are a matter of seconds."""
    rng = random.Random(4)
    long = "".join(rng.choices(secrets.BASE64.members, k=1_000_000))
    dull = "z1" * 500_000
    many = "token=abcdefgh1 " * 10_000
    docs = spark.createDataFrame([(1, long), (2, dull), (3, many)], "doc_id long, text string")
    t = time.perf_counter()
    got = {r.doc_id: r for r in secrets.scan(docs.repartition(3)).collect()}
    assert time.perf_counter() - t < 40
    assert got[1].spans == "entropy:0:1000000" and got[2].spans == "" and got[3].n_assign == 10_000
    assert got[3].spans.split(",")[9_999] == "assign:159984:159999"


# 10: toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def swapped(a, b):
    """Edit distance in which two neighbours may also change places, once."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def plain_hit(token, terms):
    """(term, edits) of a token, stems first, or None."""
    stems = [(d, n) for n, (w, s) in enumerate(terms) if s for d in [min(swapped(token[:k], w) for k in range(len(token) + 1))] if d <= toxicity.edits(w, True)]
    words = [(d, n) for n, (w, s) in enumerate(terms) if not s for d in [swapped(token, w)] if d <= toxicity.edits(w, False)]
    return (min(stems or words)[1], min(stems or words)[0]) if stems or words else None


def test_automaton_is_edit_distance():
    rng = random.Random(7)
    terms = [("idiot", False), ("scum", False), ("disgustingly", False), ("vequ", True), ("clown", False), ("stupid", True), ("moron", False)]
    auto = toxicity.Automaton(terms)
    tokens = ["idiot", "idot", "idiiot", "idioot", "ideot", "idoit", "diiot", "scam", "sucm", "scum", "vequance", "vequ", "veq", "disgustngly", "disgustinglyxx", "clowns", "clw", "xclown", "wonderful", "stupidity", "sutpidly", "stupd", "tsupid"]
    tokens += ["".join(rng.choice("idotscumlwnp") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    text = " ".join(tokens)
    x = toxicity.fold()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    sizes = np.array([len(t) for t in tokens])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    at, code = auto.match(x, starts, sizes)
    got = {int(a): (int(c - 1) // 4, int(c - 1) % 4) for a, c in zip(at, code)}
    for i, t in enumerate(tokens):
        want = plain_hit(t, terms)
        assert (i in got) == (want is not None), t
        if want and not any(s for _, s in terms[want[0] : want[0] + 1]):
            assert got[i][1] == want[1], t
    assert all(tokens.index(t) in got for t in ("idoit", "diiot", "sucm", "stupidity"))


def test_quotation_weighs_less():
    auto = toxicity.Automaton([("idiot", False)])
    texts = ["you idiot", 'the word "idiot" is rude', "an idoit there", "nothing", "I don't care you idiot, you're it", "they call it 'idiot' there"]
    f = toxicity.features(texts, auto, np.array([3.0]))
    assert f[0, 0] > 0 and f[0, 1] == 0 and f[1, 0] == 0 and f[1, 1] > 0 and f[0, 5] > 0 and f[1, 4] == 0 and not f[3].any()
    assert f[2, 0] > 0 and toxicity.features(texts, auto, np.array([3.0]), firm=frozenset([0]))[2, 2] > 0 and f[4, 0] > 0 and f[4, 1] == 0 and f[5, 1] > 0 and f[5, 0] == 0
    assert not toxicity.features(["an idoit there"], auto, np.array([3.0]), frozenset(["idoit"])).any()


def plain_features(text, model):
    tokens, k = [], 0
    while k < len(text):
        if not text[k].isalnum():
            k += 1
            continue
        e = k
        while e < len(text) and text[e].isalnum():
            e += 1
        tokens.append((k, e))
        k = e
    out, some = [0.0] * 8, set()
    mark = lambda k: text[k] in toxicity.QUOTES or text[k] in toxicity.APOSTROPHES and not (0 < k < len(text) - 1 and text[k - 1].isalnum() and text[k + 1].isalnum())
    for s, e in tokens:
        hit = plain_hit(text[s:e].lower(), model.auto.terms)
        if not hit or hit[1] and text[s:e].lower() in model.spared:
            continue
        low, high = max(0, s - toxicity.WINDOW), min(len(text), e + toxicity.WINDOW)
        near = re.sub(r"[^\w]|_", " ", text[low:s] + " " + text[e:high]).lower().split()
        quoted = sum(mark(k) for k in range(low, s)) % 2 == 1 and any(mark(k) for k in range(e, high)) or any(w in toxicity.REPORTING for w in near)
        doubtful = hit[1] > 0 and hit[0] in model.firm
        out[(2 if doubtful else 0) + quoted] += 1
        if not doubtful:
            out[4] += 0 if quoted else max(0.0, model.gain[hit[0]])
            out[5] += any(w in toxicity.ADDRESS for w in near)
            some.add(hit[0])
    out[6], out[7] = len(some), 100 * (out[0] + out[1]) / max(1, len(tokens))
    return [math.log1p(v) for v in out]


def test_toxicity_by_loop(spark):
    """Lexicon, spared words, features and scores of a small corpus, by loops."""
    rng = random.Random(10)
    plain, bad = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(5)], ["grobian", "lumpking", "zounder"]
    rows, labels = [], []
    for i in range(400):
        words, toxic = rng.choices(plain, k=rng.randint(5, 80)), i % 2
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        elif i % 20 == 0:
            words.append("zounders" if i % 40 else "zoundr")
        rows.append((i, ("x " * 12_000 if i % 50 == 1 else "") + " ".join(words), 1))
        labels.append((i, toxic))
    rows += [(900, None, 1), (901, "", 1), (902, 'he said "grobian" once', 1), (903, "you gorbian, lumpkng", 1), (904, "zoundr zounders", 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, h int").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    learned = [(i, t, y) for (i, t, _), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5]
    n1, n0 = sum(y for *_, y in learned), sum(1 - y for *_, y in learned)
    sets = [(set(t.split()), y) for _, t, y in learned]
    for w in {w for x, _ in sets for w in x if len(w) > 2}:
        c1, c0 = sum(w in x for x, y in sets if y), sum(w in x for x, y in sets if not y)
        r1, r0 = c1 / n1, (c0 + toxicity.DOUBT) / n0
        assert ((w, False) in model.auto.terms) == (c1 >= toxicity.LEAST_TEXTS and r1 / (r1 + r0) >= toxicity.PRECISION)
    assert {w for w, s in model.auto.terms if not s} == set(bad)
    clean = {w for x, y in sets if not y for w in x}
    assert model.spared == {w for w in clean if (h := plain_hit(w, model.auto.terms)) and h[1]} and model.spared
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t, _ in rows:
        z = sum(a * b for a, b in zip(plain_features(t or "", model), model.weights)) + model.bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = registry.QUERIES["op10_toxicity"](spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.96 and held[held.toxic == 1].predicted.mean() > 0.85
