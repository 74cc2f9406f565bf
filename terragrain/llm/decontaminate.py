"""Benchmark decontamination by spaced-seed hashing.

A window of SPAN tokens is hashed under fixed masks; each mask looks at half of the positions and ignores the
rest, so a substitution in an ignored position does not change the hash. Positions are dealt over four classes
(their number modulo 4) and the six masks are the pairs of classes: two substitutions touch at most two classes
and leave the mask of the other two intact. Every window within two substitutions is therefore found.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import KEY, materialise, row_key, table, without

SPAN, CLASSES = 12, 4
PAIRS = list(combinations(range(CLASSES), 2))
#: Items of fewer tokens are no evidence of a leak: such phrases stand in clean text as well. 1 takes all.
SHORTEST = 5
#: Seeds and tokens of the test side up to which it is broadcast (24 and 8 bytes each); more are joined by shuffle.
BROADCAST_SEEDS, BROADCAST_TOKENS = 1_000_000, 8_000_000
#: Everything but letters and digits separates tokens.
SEPARATOR = r"[^\p{L}\p{N}]+"


def mismatches(span: int) -> int:
    """Substitutions allowed in a window of ``span`` tokens: 2 in 12, 1 from 6 on."""
    return span // 6


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, hashed. A null text has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR)
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def class_hash(t: Column, i: Column, c: int, span: int) -> Column:
    return F.xxhash64(F.lit(span), *[F.element_at(t, i + 1 + k) for k in range(c, span, CLASSES)])


def seeds(rows: DataFrame, keys: list[str], t: str, span: int = SPAN) -> DataFrame:
    """One row per window and mask: keys, i (place of the window), h, which depends on the number of the mask. Token arrays among the
    keys are only referred to while the rows stay in one stage; leave them out of the keys if rows are to be exchanged."""
    at = rows.where(F.size(t) >= span).select(*dict.fromkeys([*keys, t]), F.explode(F.sequence(F.lit(0), F.size(t) - span)).alias("i"))
    at = at.select(*keys, "i", *[class_hash(F.col(t), F.col("i"), c, span).alias(f"c{c}") for c in range(CLASSES)])
    masks = F.array(*[F.xxhash64(F.lit(m), F.col(f"c{a}"), F.col(f"c{b}")) for m, (a, b) in enumerate(PAIRS)])
    return at.select(*keys, "i", F.explode(masks).alias("h"))


def numbered(items: DataFrame, span: int) -> DataFrame:
    """The seeds of items (item, b) with j, the place of the window, m, the number of the mask, and w, a hash of the window's tokens."""
    at = items.where(F.size("b") >= span).select("item", "b", F.explode(F.sequence(F.lit(0), F.size("b") - span)).alias("j"))
    at = at.select("item", "j", F.xxhash64(F.slice("b", F.col("j") + 1, span)).alias("w"), *[class_hash(F.col("b"), F.col("j"), c, span).alias(f"c{c}") for c in range(CLASSES)])
    masks = F.array(*[F.xxhash64(F.lit(m), F.col(f"c{a}"), F.col(f"c{b}")) for m, (a, b) in enumerate(PAIRS)])
    return at.select("item", "j", "w", F.posexplode(masks).alias("m", "h"))


def laid(hits: DataFrame, span: int) -> DataFrame:
    """Of hits (t, i, b, j, m) those whose window is within the mismatches, once for each (i, j): matched and compared of
    the whole overlap on that diagonal where a run of such windows begins, and null further on in it."""
    same = lambda i, j: F.zip_with(F.slice("t", i + 1, span), F.slice("b", j + 1, span), lambda x, y: x == y)
    wrong = lambda eq: F.size(F.filter(eq, lambda x: ~x))
    hits = hits.withColumn("eq", same(F.col("i"), F.col("j"))).where(wrong(F.col("eq")) <= mismatches(span))
    whole = [_intact(c) for c in range(CLASSES)]
    lower = F.lit(False)
    for m, (a, b) in enumerate(PAIRS):
        lower = lower | ((F.col("m") > m) & whole[a] & whole[b])
    hits = hits.where(~lower)
    back = F.least("i", "j")
    n = F.least(F.size("t") - F.col("i"), F.size("b") - F.col("j")) + back
    goes_on = (F.col("i") > 0) & (F.col("j") > 0) & (wrong(same(F.greatest(F.col("i") - 1, F.lit(0)), F.greatest(F.col("j") - 1, F.lit(0)))) <= mismatches(span))
    overlap = F.zip_with(F.slice("t", F.col("i") - back + 1, n), F.slice("b", F.col("j") - back + 1, n), lambda x, y: x == y)
    best = F.when(~goes_on, F.struct(F.size(F.filter(overlap, lambda x: x)).alias("matched"), n.alias("compared")))
    return hits.select("doc_id", "version", "item_id", "i", best.alias("best"))


def _intact(c: int) -> Column:
    return F.size(F.filter("eq", lambda x, k: (k % CLASSES == c) & ~x)) == 0


def hits_of(docs: DataFrame, bench: DataFrame, shortest: int = SHORTEST, one_each: bool = False) -> DataFrame | None:
    """(doc_id, version, item_id, i, best) of every window found; None where no item is long enough. With ``one_each``
    windows of equal tokens are looked for on behalf of one item only, which finds the same rows of ``docs``."""
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("b"))
    items = materialise(items.where(F.size("b") >= shortest).distinct(), "bench-tokens")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs)[2].alias("version"), tokens(docs["text"]).alias("t"))
    short = sorted(r["n"] for r in items.where(F.size("b") < SPAN).select(F.size("b").alias("n")).distinct().collect())  # SPAN - 1 rows at most
    out = None
    for span in [*short, SPAN]:
        some = items.where(F.size("b") >= SPAN if span == SPAN else F.size("b") == span)
        some = some.withColumn("item", F.xxhash64("item_id", "b"))
        test = numbered(some, span)
        if one_each:
            test = test.groupBy("m", "h", "w").agg(F.min(F.struct("item", "j")).alias("x")).select("m", "h", "x.item", "x.j")
        test = materialise(test, "bench-seeds")
        size = some.agg(F.sum(F.size("b")).alias("n")).first()["n"]
        if not size:
            continue
        if test.count() <= BROADCAST_SEEDS and size <= BROADCAST_TOKENS:
            hits = seeds(rows, ["doc_id", "version", "t"], "t", span).join(F.broadcast(test), "h")
            hits = hits.join(F.broadcast(some), "item")
        else:  # narrow rows travel; the tokens come to the hits alone
            hits = seeds(rows.withColumn("key", F.col("doc_id")), ["key", "version"], "t", span).join(test, "h").select("key", "version", "i", "m", "item", "j")
            hits = hits.distinct().join(some, "item").withColumnRenamed("version", "v")
            hits = hits.join(rows.distinct(), F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("v") == F.col("version")))
        hits = laid(hits, span)
        out = hits if out is None else out.unionByName(hits)
    return out


def overlaps(docs: DataFrame, bench: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Benchmark items that documents hold: doc_id, item_id, matched, compared, windows.

    A document holds an item if some window of SPAN tokens of both agrees in all but two tokens; an item of fewer tokens is
    one window itself (from 6 tokens on one of them may differ). Around each hit both token sequences are laid on each other;
    ``compared`` is the length of the longest such overlap and ``matched`` its equal tokens, ``windows`` counts the
    window starts found. Items under ``shortest`` tokens (null and empty ones too) match nothing, and neither do texts shorter than
    the item's window. Rows that share a doc_id or item_id are merged; a null id is one id. An empty table on either side
    gives an empty result; other columns are ignored.
    """
    hits = hits_of(docs, bench, shortest)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched int, compared int, windows long")
    return hits.groupBy("doc_id", "item_id").agg(
        F.max("best").alias("best"), F.count_distinct("i").alias("windows")
    ).select("doc_id", "item_id", F.col("best.matched").alias("matched"), F.col("best.compared").alias("compared"), "windows")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminated(docs: DataFrame, bench: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, see ``overlaps``; columns as they came.

    Rows are judged by their own text: a null or repeated id neither keeps nor removes another row. Null, empty and
    shorter texts stay. Without items all rows stay; an empty table gives an empty result.
    """
    hits = hits_of(docs, bench, shortest, one_each=True)
    if hits is None:
        return docs
    bad = hits.select(F.col("doc_id").isNull().alias(KEY[0]), F.coalesce("doc_id", F.lit(0).cast("long")).alias(KEY[1]), F.col("version").alias(KEY[2])).distinct()
    return without(docs, materialise(bad, "contaminated"))
