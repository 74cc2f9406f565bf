"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length within each source. Whole passes over a source are taken
first; the budget that remains is spread over the lengths in proportion, and what is left of it is fitted by
bounded-knapsack dynamic programming over lengths. Seeded order picks the documents of each length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialise, row_key, small, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Words that dynamic programming fits at first; the window is doubled until the nearest sum is proven or all is in it.
FIT = 8_192
#: Steps of dynamic programming (items times 64 words of the window) after which the window is not doubled again.
STEPS = 1 << 31
#: Rows of one (source, length) ranked by one task, and sub-buckets into which a larger group is dealt at most.
RANKED, SUBS = 256, 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) of all sources and their target: ``share`` of all words by weight, never over ``most`` times the
    source, what exceeds that shared out again. Weights go round by code point order of the sources, null last.

    Sources are numbered by ranges and the shares follow from one number, so no task and no driver holds them all.
    """
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = sizes.repartitionByRange(parts, F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source")).withColumn("id", F.monotonically_increasing_id())
    placed = materialise(placed, "mix-sources")
    part, at = F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1)
    counts, start = {r["part"]: r["n"] for r in placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}, 0  # a row a partition
    first = []
    for p in sorted(counts):
        first.append((p, start % len(weights)))
        start += counts[p]
    first = F.broadcast(sizes.sparkSession.createDataFrame(first or [], "part long, first long"))
    cycle = F.array(*map(F.lit, weights))
    rows = placed.select("source", "source_size", part, at.alias("at")).join(first, "part")
    rows = rows.select("source", "source_size", F.get(cycle, ((F.col("first") + F.col("at")) % len(weights)).cast("int")).alias("weight"))
    # A source is full if its words are fewer than level / most for each unit of weight; full ones raise the level of the others.
    total = rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level = -1.0
    while True:
        full = F.lit(most) * F.col("source_size") < F.lit(level) * F.col("weight")
        r = rows.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("open")).first()
        if not r["open"]:
            break
        now = (share * total - most * r["full"]) / r["open"]
        if now <= level:
            break
        level = now
    full = F.lit(most) * F.col("source_size") < F.lit(level) * F.col("weight")
    return rows.select("source", "source_size", F.when(full, F.lit(most) * F.col("source_size")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def reached(lengths: list[int], counts: list[int], wide: int, aim: float) -> tuple[int, np.ndarray, np.ndarray]:
    """The sum nearest to ``aim`` (of two the lower) that the counts of lengths make within ``wide``, and for every sum the
    length's place and the number of it that came last. Bit v of ``sums`` is set if v can be made; every sum is new once."""
    sums, mask = 1, (1 << (wide + 1)) - 1
    place, number = np.zeros(wide + 1, np.int32), np.zeros(wide + 1, np.int64)
    near = math.ceil(aim - 0.5)
    for i, (n, k) in enumerate(zip(lengths, counts)):
        left, chunk = k, 1
        while left > 0 and min(chunk, left) * n <= wide:
            m = min(chunk, left)
            fresh = (sums << (m * n)) & mask & ~sums
            if fresh:
                sums |= fresh
                new = np.flatnonzero(np.unpackbits(np.frombuffer(fresh.to_bytes(wide // 8 + 1, "little"), np.uint8), bitorder="little"))
                place[new], number[new] = i, m
                if sums >> near & 1:
                    return near, place, number
            left, chunk = left - m, chunk * 2
    first = math.floor(aim)
    below = (sums & ((1 << (first + 1)) - 1)).bit_length() - 1
    above = sums >> (first + 1)
    above = first + (above & -above).bit_length() if above else None
    return (above if above is not None and above - aim < aim - below else below), place, number


def fit(lengths: list[int], counts: list[int], budget: int, window: int = FIT, steps: int = STEPS) -> list[int]:
    """How many documents of each length to take, so that their lengths add up to ``budget`` as nearly as can be; of two
    sums that are as near the lower one counts.

    A proportional share of each length comes first, then an exact bounded knapsack on the rest, in a window of several times the
    greatest length. Where that does not meet the budget as nearly as the lengths' common divisor allows, the window is doubled, up
    to the whole budget: then the knapsack is exact over everything. Only a window beyond ``steps`` of work is not doubled again.
    """
    some = [i for i, (n, k) in enumerate(zip(lengths, counts)) if n and k]
    total = sum(lengths[i] * counts[i] for i in some)
    if budget >= total:
        return list(counts)
    divisor = math.gcd(*(lengths[i] for i in some))
    least = min(budget % divisor, -budget % divisor)
    window, best, off = max(window, 4 * max(lengths[i] for i in some)), None, None
    items = sum(counts[i].bit_length() for i in some)
    while True:
        take = [0] * len(lengths)
        if budget > window:
            part, due, got = (budget - window // 2) / total, 0.0, 0
            for i in some:  # each length its share; what is cut off a length passes to the next
                due += part * lengths[i] * counts[i]
                take[i] = max(0, min(counts[i], int((due - got) / lengths[i])))
                got += take[i] * lengths[i]
        rest = budget - sum(lengths[i] * take[i] for i in some)
        order = sorted(some, key=lambda i: lengths[i])
        # Sums beyond twice the rest are farther off than none at all; scaled down by the divisor.
        scale = lambda x: x // divisor
        spare = min(rest, max(lengths[i] for i in some))
        at, place, number = reached([scale(lengths[i]) for i in order], [counts[i] - take[i] for i in order], scale(rest + spare), rest / divisor)
        while at:
            i, m = int(place[at]), int(number[at])
            take[order[i]] += m
            at -= m * scale(lengths[order[i]])
        now = abs(sum(lengths[i] * take[i] for i in some) - budget)
        if off is None or now < off:
            best, off = take, now
        if off <= least or window >= budget or items * (2 * window // divisor) // 64 > steps:
            return best
        window *= 2


def seeded(docs: DataFrame, seed: int) -> list[Column]:
    """source, size (words) and h, the place in the seeded order (63 bits) by id and text."""
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return [docs["source"].alias("source"), size.alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs["doc_id"], row_key(docs)[2]), 1).alias("h")]


def cuts(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """For every (source, size): source_size, target, whole (times that every row is taken), and the rows taken once more: those
    with h below ``cut`` and ``ties`` of those (``tied``) with h at it. A written table, one row for each length of a source."""
    hist = materialise(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    goal = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source: its lengths (as many as there are different lengths), its budget."""
        pdf = pdf.sort_values("size")
        total, goal = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        whole = min(int(goal // total), int(most)) if total else 0
        left = round(goal - whole * total)
        extra = fit(pdf["size"].tolist(), pdf["n"].tolist(), left) if left > 0 and whole < most else [0] * len(pdf)
        return pd.DataFrame({"source": pdf.source, "size": pdf["size"], "n": pdf.n, "source_size": pdf.source_size, "target": pdf.target, "whole": whole, "extra": extra})

    chosen = hist.alias("l").join(goal.alias("p"), F.col("l.source").eqNullSafe(F.col("p.source"))).select("l.source", "size", "n", "source_size", "target")
    chosen = materialise(chosen.groupBy("source").applyInPandas(choose, "source string, size long, n long, source_size long, target double, whole long, extra long"), "mix-choice")
    # The cut is the h of the row number ``extra``. Sub-buckets are ranges of h; only the one that holds the cut is ranked.
    some = chosen.where("extra > 0 AND extra < n").select("source", "size", "n", "extra")
    parts = F.least(F.ceil(F.col("n") / RANKED), F.lit(SUBS)).cast("long")
    same = F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size"))
    dealt = rows.alias("r").join(small(some).alias("c"), same).select("r.source", "r.size", "h", "extra", F.shiftright(F.shiftright("h", 32) * parts, 31).alias("sub"))
    subs = dealt.groupBy("source", "size", "extra", "sub").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("sub"))
    subs = subs.withColumn("upto", upto).where("upto >= extra AND upto - m < extra").select("source", "size", "sub", (F.col("extra") - F.col("upto") + F.col("m")).alias("nth"))
    held = dealt.alias("r").join(materialise(subs, "mix-subs").alias("c"), same & (F.col("r.sub") == F.col("c.sub"))).select("r.source", "r.size", "nth", "h")
    tied = held.groupBy("source", "size", "nth", "h").agg(F.count(F.lit(1)).alias("tied"))
    upto = F.sum("tied").over(Window.partitionBy("source", "size").orderBy("h"))
    found = tied.withColumn("upto", upto).where("upto >= nth AND upto - tied < nth").select("source", "size", F.col("h").alias("cut"), (F.col("nth") - F.col("upto") + F.col("tied")).alias("ties"), "tied")
    out = chosen.alias("r").join(found.alias("c"), same, "left").select(
        "r.source", "r.size", "source_size", "target", "whole",
        F.coalesce("cut", F.when(F.col("extra") > 0, F.lit(2**63 - 1)).otherwise(-1)).alias("cut"), F.coalesce("ties", F.lit(0)).alias("ties"), F.coalesce("tied", F.lit(0)).alias("tied"),
    )
    return materialise(out, "mix-cuts")


def counted(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` (with source, size, h) with source_size, target and times, how often each is taken."""
    same = F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size"))
    both = rows.alias("r").join(small(cut).alias("c"), same).select("r.*", "source_size", "target", "whole", "cut", "ties", "tied")
    split = (F.col("h") == F.col("cut")) & (F.col("ties") < F.col("tied"))
    sure = both.where(~split).withColumn("times", F.col("whole") + (F.col("h") <= F.col("cut")).cast("long"))
    if cut.where("ties < tied").limit(1).count():  # rows alike in id and text at a cut: any ``ties`` of them
        nth = F.row_number().over(Window.partitionBy("source", "size").orderBy("h"))
        sure = sure.unionByName(both.where(split).withColumn("times", F.col("whole") + (nth <= F.col("ties")).cast("long")))
    return sure.drop("whole", "cut", "ties", "tied")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """The mix, one row per input row: doc_id, size (words), source_size, target (both of its source), taken
    (words that the mix takes from this row, repeats counted: 0, size or 2 * size), source, times.

    A null text has no words; a null source is a source of its own and comes last. A row without words is
    taken as 0. Rows are taken in a seeded order of id and text; of rows alike in both any will do, so reruns agree. An
    empty table gives an empty result. Other columns are ignored.
    """
    rows = materialise(docs.select(docs["doc_id"].cast("long").alias("doc_id"), *seeded(docs, seed)), "mix-rows")
    out = counted(rows, cuts(rows, weights, share, most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "source", "times")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("times")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """The mixed corpus itself: each row as often as the mix takes it, see ``mix``, with the columns of ``docs``.

    Rows without words (null and empty texts too) are not part of any budget and stay once. Null and repeated ids are no
    exception: every row is taken for itself. An empty table gives an empty result.
    """
    keys = ["source", "size", "h"]
    cut = cuts(materialise(docs.select(*seeded(docs, seed)), "mix-rows"), weights, share, most)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__tg_row"), *seeded(docs, seed))
    often = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("times").cast("int"))
    taken = counted(rows.select("__tg_row", *keys), cut).withColumn("__tg_often", often).where("__tg_often > 0")
    return taken.select("__tg_row", F.explode(F.sequence(F.lit(1), F.col("__tg_often"))).alias("__tg_copy")).select("__tg_row.*")
