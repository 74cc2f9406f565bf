"""SimHash near-dedup with pivot distance tables.

Every fingerprint gets a table of its Hamming distances to fixed reference fingerprints (the pivots). By the
triangle inequality two fingerprints within ``d`` bits differ by at most ``d`` in every coordinate, so a
pair that differs by more in one of them is discarded before its bits are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import KEY, discard, lean, materialise, row_key, small, table, values, without
from .components import components

SEED = 42
PIVOTS = 16
#: Fingerprints that share a block (or a cell of pivot distances within it), up to which their pairs are compared.
BUCKET = 32
#: Width of a cell of pivot distances, and pivots that deal a crowded block into cells at most.
CELL, DEEP = 8, 6
#: Shingles counted at once by a Python worker.
AT_ONCE = 500_000
ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle (lower-cased A-Z, words between ASCII white space); the whole text if shorter."""
    w = (text or "").encode().lower().split()  # bytes.lower() and bytes.split() know ASCII only
    if not w:
        return np.empty(0, "<u8")
    n = max(1, len(w) - k + 1)
    parts = map(b" ".join, zip(*(w[i:] for i in range(k)))) if len(w) >= k else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", n)


def remix(h: np.ndarray, j: int) -> np.ndarray:
    """Further 64 hash bits from 64: the finaliser of splitmix64 on a shifted state. j = 0 leaves them as they are."""
    if j == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * j) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def majority(hashes: list[np.ndarray], longs: int) -> np.ndarray:
    """(texts, longs) fingerprints: a bit is set if it is set in over half of the text's hashes.

    Eight bit counters ride in each 64-bit sum, over at most 255 hashes at a time.
    """
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros((len(hashes), longs), "<u8")
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    all_ = np.concatenate([hashes[i] for i in some])
    starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
    cuts = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(starts, sizes[some])])
    owner = np.searchsorted(cuts, starts)
    for j in range(longs):
        h = remix(all_, j)
        for s in range(8):
            sums = np.add.reduceat((h >> np.uint64(s)) & ONES, cuts).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(sums.astype(np.int64), owner, axis=0)
            set_ = (counts * 2 > sizes[some][:, None]).astype(np.uint64)
            for b in range(8):
                out[some, j] |= set_[:, b] << np.uint64(8 * b + s)
    return out


def groups_of(texts: Iterable, k: int) -> Iterator[list[np.ndarray]]:
    group, n = [], 0
    for t in texts:
        group.append(shingle_hashes(t, k))
        n += len(group[-1])
        if n >= AT_ONCE:
            yield group
            group, n = [], 0
    if group:
        yield group


def fingerprints(docs: DataFrame, k: int, longs: int = 1) -> DataFrame:
    """doc_id, f0 .. f<longs-1>. Whole texts; a null text has no words."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in groups_of(values(batch.column("text")), k):
                f = majority(group, longs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(group))] + [pa.array(f[:, j].view("<i8")) for j in range(longs)], names)
                done += len(group)

    names = ["doc_id"] + [f"f{j}" for j in range(longs)]
    schema = ", ".join(f"{c} long" for c in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(scan), schema)


def pivots(longs: int, n: int = PIVOTS) -> list[list[int]]:
    """Fixed reference fingerprints, as signed longs."""
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    return rng.integers(0, 2**64, (n, longs), dtype=np.uint64).view(np.int64).tolist()


def with_pivots(reps: DataFrame, longs: int) -> DataFrame:
    """The pivot distance table: one column per reference fingerprint."""
    dist = [sum((F.bit_count(F.col(f"f{j}").bitwiseXOR(F.lit(p[j]))) for j in range(longs)), F.lit(0)).cast("smallint") for p in pivots(longs)]
    return reps.select("*", *[d.alias(f"p{i}") for i, d in enumerate(dist)])


def gap(most: int) -> Column:
    """Of the pair x, y: no pivot coordinate differs by more than ``most``."""
    return F.greatest(*[F.abs(F.col(f"x.p{i}") - F.col(f"y.p{i}")) for i in range(PIVOTS)]) <= most


def bits(longs: int, most: int) -> Column:
    """Of the pair x, y: no more bits than ``most`` differ."""
    return sum((F.bit_count(F.col(f"x.f{j}").bitwiseXOR(F.col(f"y.f{j}"))) for j in range(longs)), F.lit(0)) <= most


def _further(ends: Column) -> Callable[[Column], Column]:
    return lambda a: F.transform(ends, lambda c: a * 16 + c)


def cells(deep: Column, reach: int) -> Column:
    """The cells of pivot distances that a fingerprint reaches within ``reach`` bits, by its first ``deep`` pivots; one cell for a reach of 0."""
    out = F.array(F.lit(0).cast("long"))
    for i in range(DEEP):
        ends = F.array_distinct(F.array(*[F.floor((F.col(f"p{i}") + r) / CELL) for r in sorted({-reach, reach})]))
        ends = F.when(deep > i, ends).otherwise(F.array(F.lit(0).cast("long")))
        out = F.flatten(F.transform(out, _further(ends)))
    return out


def candidates(reps: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pairs x, y of fingerprints that share a block of bits, and the fingerprints of crowds that are left to the ball way.

    Fingerprints at most 2 bits apart agree on one of three blocks of bits. Where more than BUCKET share a block, the
    pivot table deals them into cells: each stands in one cell and meets those that stand in the cells within ``most`` of
    its coordinates. A cell in which still more than BUCKET stand, and whoever meets it, is a crowd.
    """
    p = [f"p{i}" for i in range(PIVOTS)]
    cut = F.array(*[F.struct(F.lit(n).alias("block"), F.shiftrightunsigned(F.shiftleft("f0", left), 64 - wide).alias("key")) for n, left, wide in ((0, 0, 22), (1, 22, 21), (2, 43, 21))])
    rows = reps.select("f0", *p, F.explode(cut).alias("b")).select("f0", *p, "b.block", "b.key")
    sizes = materialise(rows.groupBy("block", "key").count().where("count > 1"), "simhash-blocks")
    deep = F.when(F.col("count") > BUCKET, F.least(F.lit(DEEP), F.ceil(F.log(F.col("count") / BUCKET) / math.log(3)))).otherwise(0)
    rows = rows.join(sizes, ["block", "key"]).withColumn("deep", deep)
    at = ["block", "key", "cell"]
    stand = rows.withColumn("cell", cells(F.col("deep"), 0)[0])
    meet = rows.withColumn("cell", F.explode(cells(F.col("deep"), most)))
    full = materialise(stand.groupBy(*at).count().where(F.col("count") > BUCKET).select(*at), "simhash-full")
    pairs = meet.join(full, at, "left_anti").alias("x").join(stand.join(full, at, "left_anti").alias("y"), at).where(F.col("x.f0") < F.col("y.f0"))
    return pairs, meet.join(full, at, "left_semi").select("f0").distinct()


def pivot_report(docs: DataFrame, k: int = 3, most: int = 2) -> DataFrame:
    """One row: pairs compared, by_pivots (discarded by the pivot table), by_bits (by the bits alone), links, crowd (fingerprints on the ball way)."""
    reps = with_pivots(fingerprints(docs, k).select("f0").distinct(), 1)
    pairs, crowd = candidates(reps, most)
    n = lambda c: F.count_if(c)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), n(~gap(most)).alias("by_pivots"), n(gap(most) & ~bits(1, most)).alias("by_bits"), n(gap(most) & bits(1, most)).alias("links")).crossJoin(crowd.agg(F.count(F.lit(1)).alias("crowd")))


def linked_components(docs: DataFrame, k: int = 3) -> DataFrame:
    """Fingerprints of 64 bits, linked at 2 or fewer differing bits.

    One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id
    reachable, null if all ids of the component are null), component_size (different fingerprints). Texts
    without words (null, empty, white space) have fingerprint zero and link like any other. Rows with one
    fingerprint are one node, so copies are never paired. An empty table gives an empty result; other
    columns are ignored.

    ``candidates`` are thinned out by the pivot table, and the bits decide. The fingerprints of a crowd are not paired
    up: each links to all 65 words within one bit, and two lie within two bits exactly if they share such a word,
    of which each belongs to 65 fingerprints at most.
    """
    fps = materialise(fingerprints(docs, k), "simhash-fp")
    reps = materialise(with_pivots(fps.groupBy("f0").agg(F.min("doc_id").alias("least")), 1), "simhash-reps")
    pairs, crowd = candidates(reps)
    pairs = pairs.where(gap(2) & bits(1, 2)).select(F.col("x.f0").alias("a"), F.col("y.f0").alias("b"))
    flips = F.expr("concat(array(0L), transform(sequence(0, 63), s -> shiftleft(1L, s)))")
    near = crowd.select("f0", F.explode(flips).alias("m")).select("f0", F.col("f0").bitwiseXOR(F.col("m")).alias("z"))
    least = near.groupBy("z").agg(F.min("f0").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ball = near.join(least.select("z", "b"), "z").select(F.col("f0").alias("a"), "b")
    root = components(pairs.union(ball))
    at = reps.select("f0", "least").join(root, F.col("f0") == F.col("node"), "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    at = materialise(at, "simhash-root")
    ids = at.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("component_size"))
    at = at.join(ids, "root").select("f0", "component_id", "component_size")
    return fps.join(at, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


#: For near copies by similarity: 256-bit fingerprints, and BANDS keys, each of the least values of the shingles' hashes
#: under ROWS hash functions. Two texts of similarity s share a key with chance 1 - (1 - s ** ROWS) ** BANDS: 0.99993 at 0.8,
#: whatever the size of the corpus.
LONGS, BANDS, ROWS, SIMILARITY = 4, 24, 5, 0.8
#: Members of a bucket (or part of one) that one task holds together at most, and their shingles.
BLOCK, WEIGHT = 256, 4_000_000
#: The same where part is held against part.
ACROSS = 1024


def most_bits(similarity: float, longs: int = LONGS, slack: float = 4.5) -> int:
    """Differing bits expected at this Jaccard similarity of shingles (half an angle's share of the bits), plus ``slack`` standard deviations."""
    n, shared = 64 * longs, 2 * similarity / (1 + similarity)
    p = float(np.arccos(shared) / np.pi)
    return int(n * p + slack * (n * p * (1 - p)) ** 0.5)


def band_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """(texts, BANDS) keys of texts that have shingles."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    all_, starts = np.concatenate(hashes), np.concatenate([[0], np.cumsum([len(h) for h in hashes])[:-1]])
    out = np.zeros((len(hashes), BANDS), "<u8")
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            for factor, term in rng.integers(0, 2**64, (ROWS, 2), dtype=np.uint64):
                out[:, band] = remix(out[:, band] ^ np.minimum.reduceat(all_ * (factor | np.uint64(1)) + term, starts), band + 1)
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Every row's key (``row_key``), n (different shingles), shingles (a hash of their set), f0 .. f3 and the keys of
    its bands (null without words). Whole texts; a null text has no words. Each different shingle counts once."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in groups_of(values(batch.column("text")), k):
                group = [np.unique(h) for h in group]
                f, sizes = majority(group, LONGS), np.array([len(h) for h in group])
                some = np.flatnonzero(sizes)
                keys = band_keys([group[i] for i in some]) if len(some) else np.empty((0, BANDS), "<u8")
                ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                sets = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in group], "<u8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(done, len(group)) for c in KEY]
                    + [pa.array(sizes), pa.array(sets.view("<i8"))] + [pa.array(f[:, j].view("<i8")) for j in range(LONGS)]
                    + [pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view("<i8").reshape(-1)))],
                    [*KEY, "n", "shingles", *[f"f{j}" for j in range(LONGS)], "keys"],
                )
                done += len(group)

    schema = "__tg_none boolean, __tg_id long, __tg_text long, n long, shingles long, " + ", ".join(f"f{j} long" for j in range(LONGS)) + ", keys array<long>"
    return docs.select(*row_key(docs), docs["text"].cast("string").alias("text")).mapInArrow(lean(scan), schema)


def whole_units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, in pieces that end where a value of it ends."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(0).to_numpy()
        cut = int(np.searchsorted(unit, unit[-1]))
        if kept and (cut or kept[-1].column(0)[-1].as_py() != unit[0]):
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def pivot_table(f: list[np.ndarray]) -> np.ndarray:
    """(fingerprints, pivots) Hamming distances to the reference fingerprints."""
    return np.stack([sum(np.bitwise_count(c ^ np.uint64(q & (2**64 - 1))).astype(np.int16) for c, q in zip(f, p)) for p in pivots(LONGS)], axis=1)


def may_link(f: list[np.ndarray], p: np.ndarray, x: np.ndarray | int, y: np.ndarray, most: int) -> np.ndarray:
    """Of fingerprints x against y: not discarded by a pivot coordinate, and then within ``most`` bits."""
    near = (np.abs(p[x] - p[y]) <= most).all(axis=1)
    bits = sum(np.bitwise_count(c[x] ^ c[y]).astype(np.int16) for c in f)
    return near & (bits <= most)


def in_parts(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` of buckets (columns bucket, node, members, weight) with parts, the parts that their bucket is dealt into, and own, the row's part."""
    parts = F.greatest(F.ceil(F.col("members") / most), F.ceil(F.col("weight") / WEIGHT)).cast("long")
    return rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))


def hubs(rows: DataFrame, most: int) -> DataFrame:
    """(bucket, a, b): each member a of a bucket's part with the part's hub b, if the pivot table and the bits let them be
    near copies; and with b null the hub of each part of a bucket with several. The hub is the member nearest to the bits that most members have."""
    f = [f"f{j}" for j in range(LONGS)]

    def elect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches):
            unit, bucket, node, parts = (t[c].to_numpy() for c in ("unit", "bucket", "node", "parts"))
            code = [t[c].to_numpy().view(np.uint64) for c in f]
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[starts, len(unit)])
            own = np.repeat(np.arange(len(starts)), sizes)
            away = np.zeros(len(unit), np.int32)
            for c in code:
                bits = np.unpackbits(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                common = np.add.reduceat(bits.astype(np.int32), starts, axis=0) * 2 > sizes[:, None]
                away += np.bitwise_count(c ^ np.packbits(common, axis=1, bitorder="little").view("<u8")[:, 0][own])
            hub = np.lexsort((node, away, own))[starts][own]
            x = np.flatnonzero(node != node[hub])
            x = x[may_link(code, pivot_table(code), x, hub[x], most)]
            chain = np.unique(hub[parts > 1])
            at = np.r_[x, chain]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(node[at]), pa.array(np.r_[node[hub[x]], node[chain]], mask=np.arange(len(at)) >= len(x))], ["bucket", "a", "b"])

    units = in_parts(rows, BLOCK).select(F.xxhash64("bucket", "own").alias("unit"), "bucket", "node", "parts", *f)
    return units.repartition("unit").sortWithinPartitions("unit", "bucket", "node").mapInArrow(lean(elect), "bucket long, a long, b long")


def sets_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, set): the sorted hashes of the different shingles of each node; ``nodes`` names the row that stands for it."""
    texts = docs.select(*row_key(docs), docs["text"].cast("string").alias("text")).join(small(nodes), KEY)
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in groups_of(values(batch.column("text")), k):
                group = [np.unique(h) for h in group]
                ends = np.concatenate([[0], np.cumsum([len(h) for h in group])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(done, len(group)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(group).view("<i8")))], ["node", "set"])
                done += len(group)

    return texts.mapInArrow(lean(scan), "node long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(lean(check), "a long, b long")


def unsettled(rows: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """Links (a, b) between members of one bucket whose ``root`` differs: part against part, every such pair that the pivot
    table and the bits let through is compared exactly, until a link has made the two roots one."""
    f = [f"f{j}" for j in range(LONGS)]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches):
            unit = t["unit"].to_numpy()
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            a, b = [], []
            for s, e in zip(starts, np.r_[starts[1:], len(unit)]):
                part = t.slice(s, e - s).combine_chunks()
                node, code = part["node"].to_numpy(), [part[c].to_numpy().view(np.uint64) for c in f]
                label, table = np.unique(part["root"].to_numpy(), return_inverse=True)[1], pivot_table(code)
                if label.max() == 0:
                    continue
                lists = [x.values.to_numpy() for x in part["set"]]
                sizes = np.array([len(x) for x in lists])
                values, ids = np.unique(np.concatenate(lists), return_inverse=True)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                mark, every = np.zeros(len(values), bool), np.arange(len(node))
                for x in np.flatnonzero(label != np.bincount(label).argmax()):
                    fits = (np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x])) & (label != label[x])
                    y = every[fits]
                    y = y[may_link(code, table, np.full(len(y), x), y, most)]
                    if not len(y):
                        continue
                    mark[ids[ends[x] : ends[x + 1]]] = True
                    common = np.add.reduceat(mark[ids], ends[:-1], dtype=np.int64)[y]
                    mark[ids[ends[x] : ends[x + 1]]] = False
                    for z in y[common >= similarity * (sizes[x] + sizes[y] - common)]:
                        if label[z] != label[x]:
                            a.append(node[x])
                            b.append(node[z])
                            label[label == label[z]] = label[x]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    two = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: (o != F.col("own")) | (F.col("parts") == 1)), lambda o: F.struct(F.least("own", o).alias("lo"), F.greatest("own", o).alias("hi")))
    units = in_parts(rows, ACROSS).select("bucket", "node", "root", *f, F.explode(two).alias("u")).select(F.xxhash64("bucket", "u.lo", "u.hi").alias("unit"), "node", "root", *f)
    units = units.join(sets, "node").select("unit", "node", "root", *f, "set")
    return units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(lean(compare), "a long, b long").distinct()


def near_rows(docs: DataFrame, k: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """Every row that shares a group of near copies with others: KEY, keep (the key of the group's row that stays).

    Two texts are near copies if their sets of k-word shingles reach the similarity; groups are what such links connect.
    Rows with one set of shingles, such as all texts without words, are one node. Nodes that share the key of a band
    are a bucket. Each member is first held against the hub of its bucket (of its part, where the bucket is large, and
    hubs against each other); where that leaves several components in a bucket, all pairs across them are compared, part against
    part, so no bucket is too full. The pivot table and the bits of the fingerprints discard pairs that are farther apart than
    near copies ever are (``most_bits``); what links is the exact similarity alone. The row with the least id stays, of several such
    rows that with the least text hash; null ids come last.
    """
    most, f = most_bits(similarity), [f"f{j}" for j in range(LONGS)]
    rows = materialise(sketches(docs, k), "near-sketches")
    first = F.min(F.struct(*KEY)).alias("row")
    reps = rows.groupBy("f0", "shingles").agg(first, F.first("n").alias("n"), F.first("keys").alias("keys"), *[F.first(c).alias(c + "_") for c in f[1:]])
    reps = materialise(reps.select(F.monotonically_increasing_id().alias("node"), "row", "shingles", "n", "keys", "f0", *[F.col(c + "_").alias(c) for c in f[1:]]), "near-nodes")
    spread = reps.select("node", "n", F.explode("keys").alias("bucket"))
    shared = materialise(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")).where("members > 1"), "near-buckets")
    # Most keys are one text's alone, so only their narrow rows meet the buckets; fingerprints come to those that are left.
    inside = materialise(spread.select("node", "bucket").join(shared, "bucket").join(reps.select("node", *f), "node"), "near-members")
    found = materialise(hubs(inside, most), "near-hubs")
    chains = found.where("b is null").select("bucket", "a")
    chains = chains.join(chains.groupBy("bucket").agg(F.min("a").alias("b")), "bucket").where("a <> b").select("a", "b")
    pairs = materialise(found.where("b is not null").select("a", "b").union(chains).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-pairs")
    crowds = inside.where("members > 2")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowds.select("node")).distinct()
    sets = materialise(sets_of(docs, materialise(reps.join(needed, "node").select("row.*", "node"), "near-needed"), k), "near-sets")
    links = materialise(verified(pairs, sets, similarity), "near-links")
    root = materialise(components(links), "near-root")
    crowds = materialise(crowds.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-crowds")
    open_ = crowds.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    more = materialise(unsettled(crowds.join(open_, "bucket", "left_semi"), sets, similarity, most), "near-more")
    root = components(links.union(more))
    nodes = reps.select("node", "row", "f0", "shingles").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = nodes.groupBy("root").agg(F.min("row").alias("keep"))
    nodes = materialise(nodes.join(keep, "root").select("f0", "shingles", "keep"), "near-keep")
    out = materialise(rows.join(nodes, ["f0", "shingles"]).where(F.struct(*KEY) != F.col("keep")).select(*KEY, "keep"), "near-gone")
    discard(rows, reps, shared, inside, found, pairs, sets, links, crowds, more, nodes)
    return out


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies; columns as they came. Rows alike in id and text are one document
    and stay or go together; a null id is no reason to stay, and yields to any other id. All texts without words are
    copies of each other. An empty table gives an empty result."""
    return without(docs, near_rows(docs).select(*KEY).distinct())
