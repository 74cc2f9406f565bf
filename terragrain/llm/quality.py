"""Quality classifier: an interpolated modified Kneser-Ney n-gram model over characters.

The model is trained on all trusted text. Its symbols are the characters themselves, of any script, with one symbol for
any capital and one for any digit; an n-gram is ORDER of them in one long, and the count tables grow with what the corpus
holds. Counts are gathered per task and added up by n-gram; continuation counts, discounts and interpolation weights come from joins of
the count tables of neighbouring orders, each sharded by its n-gram. Scoring is a join as well: documents are dealt into
chunks, a chunk asks for its different n-grams, these meet the count tables shard by shard, and what they cost comes back to the chunk,
which adds it up for each document. Documents whose perplexity lies outside the quantiles of their language are rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import KEY, give_back, lean, materialise, row_key, small, table, values, without

ORDER, BITS = 4, 16
#: Symbols of any capital and of any digit; a character that would take one of them takes the next.
CAPITAL, DIGIT, FIRST = 1, 2, 3
#: The threshold: this quantile of the trusted documents' bits per character, plus MARGIN bits.
QUANTILE, MARGIN = 0.996, 0.03
#: A text of this many characters counts half: its bits are drawn half-way to the median of its language.
SHRINK = 60.0
#: Bits per character are counted in bins of this width to find quantiles.
BIN = 0.001
#: Trusted documents that a language needs for a threshold of its own; others take that of all languages.
LEAST = 50
#: Bytes of text in a chunk, about; characters that a worker holds at once; values of an array that is addressed by n-gram.
CHUNK, AT_ONCE, DENSE = 8_000_000, 1_000_000, 1 << 24
#: Partitions that chunks are dealt to at most; beyond that a partition holds several chunks.
PARTS = 50_000


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Code point -> symbol of BITS bits. Characters beyond the first 65,536 share those of the private area."""
    out = np.arange(0x110000, dtype=np.int64)
    out[0x10000:] = 0xE000 + out[0x10000:] % 0x1900
    out = np.maximum(out, FIRST).astype(np.uint16)
    for c in range(0x3000):
        if chr(c).isupper():
            out[c] = CAPITAL
        elif chr(c).isdigit():
            out[c] = DIGIT
    return out


def chunks(texts: Iterable) -> Iterator[list[str]]:
    group, n = [], 0
    for t in texts:
        group.append(t or "")
        n += len(group[-1])
        if n >= AT_ONCE:
            yield group
            group, n = [], 0
    if group:
        yield group


class Grams:
    """The n-grams that end at each character of some texts, every text led in by ORDER - 1 blanks.

    They are numbered by the symbols that occur, so that few symbols make numbers small enough to address an array;
    numbers are in the order of the n-grams."""

    def __init__(self, texts: list[str]) -> None:
        lead = " " * (ORDER - 1)
        code = symbols()[np.frombuffer("".join(lead + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.some = np.flatnonzero(np.bincount(code, minlength=1 << BITS))
        self.own = np.full(1 << BITS, -1, np.int64)
        self.own[self.some] = np.arange(len(self.some))
        base, ids = len(self.some), self.own[code]
        self.span = base**ORDER
        g = np.zeros(max(0, len(ids) - ORDER + 1), np.int64)
        for k in range(ORDER):
            g = g * base + ids[k : len(ids) - ORDER + 1 + k]
        starts = np.concatenate([[0], np.cumsum(self.sizes + ORDER - 1)[:-1]]).astype(np.int64)
        keep = np.ones(len(code), bool)
        for k in range(ORDER - 1):
            keep[starts + k] = False  # windows that end within a lead-in
        self.at = g[keep[ORDER - 1 :]]

    def packed(self, numbers: np.ndarray) -> np.ndarray:
        """The n-grams of these numbers, BITS bits a symbol."""
        out = np.zeros(len(numbers), np.uint64)
        for k in range(ORDER):
            out |= self.some[numbers // len(self.some) ** k % len(self.some)].astype(np.uint64) << np.uint64(BITS * k)
        return out.view(np.int64)

    def different(self) -> np.ndarray:
        if self.span > DENSE:
            return self.packed(np.unique(self.at))
        seen = np.zeros(self.span, bool)
        seen[self.at] = True
        return self.packed(np.flatnonzero(seen))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.unique(self.at, return_counts=True)
        return self.packed(at), n

    def summed(self, grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """For each text the sum of what its n-grams cost."""
        number, known = np.zeros(len(grams), np.int64), np.ones(len(grams), bool)
        for k in reversed(range(ORDER)):
            own = self.own[(grams.view(np.uint64) >> np.uint64(BITS * k)).astype(np.int64) & (1 << BITS) - 1]
            number, known = number * len(self.some) + own, known & (own >= 0)
        number, bits = number[known], bits[known]
        if self.span <= DENSE:
            table_ = np.zeros(self.span, np.float32)
            table_[number] = bits
            each = table_[self.at]
        else:
            order = np.argsort(number)
            each = bits[order][np.searchsorted(number[order], self.at)]
        out, some = np.zeros(len(self.sizes)), np.flatnonzero(self.sizes)
        if len(some):
            out[some] = np.add.reduceat(each, np.concatenate([[0], np.cumsum(self.sizes)[:-1]])[some], dtype=np.float64)
        return out


def count_grams(trusted: DataFrame) -> DataFrame:
    """(g, c) of every n-gram of ORDER symbols in trusted text, over all of it."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in chunks(values(batch.column("text"))):
                g, n = Grams(group).counted()
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], ["g", "c"])

    return trusted.select("text").mapInArrow(lean(scan), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def suffix(g: str | Column, k: int) -> Column:
    """The last k symbols."""
    g = F.col(g) if isinstance(g, str) else g
    return g if k >= ORDER else g.bitwiseAND(F.lit((1 << BITS * k) - 1))


def smoothed(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order k: (g, p) with the discounted share p of every seen k-gram, and (ctx, w) with the weight that a context
    passes to the lower order. The lower orders count in how many contexts an n-gram continues."""
    out, level = {}, counts
    for k in range(ORDER, 0, -1):
        level = materialise(level, f"kn-{k}")
        of = {r["c"]: r["n"] for r in level.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n2, n3, n4 = (float(of.get(i, 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [max(0.0, min(i, i - (i + 1) * y * b / a)) if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = level.select("g", "c", cut.alias("d"), F.shiftrightunsigned("g", BITS).alias("ctx"))
        sums = materialise(rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("spare")), f"kn-context-{k}")
        out[k] = rows.join(sums, "ctx").select("g", ((F.col("c") - F.col("d")) / F.col("total")).alias("p")), sums.select("ctx", (F.col("spare") / F.col("total")).alias("w"))
        if k > 1:
            level = level.select(suffix("g", k - 1).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    return out


class Model:
    """The tables of ``smoothed`` and the number of symbols; it stays distributed."""

    def __init__(self, trusted: DataFrame) -> None:
        """Fit on all trusted text. Without any, every n-gram is equally likely."""
        self.tables = smoothed(count_grams(trusted))
        self.size = self.tables[1][0].count() + 1  # and one for every symbol not seen

    def cost(self, grams: DataFrame) -> DataFrame:
        """(g, bits) of different n-grams (a column g): joins with the tables of each order from the lowest up."""
        p = None
        for k in range(1, ORDER + 1):
            seen, weights = self.tables[k]
            need = grams.select(suffix("g", k).alias("g")).distinct().withColumn("ctx", F.shiftrightunsigned("g", BITS))
            need = need.join(seen, "g", "left").join(weights, "ctx", "left")
            if p is None:
                lower = F.lit(1.0 / self.size)
            else:
                need, lower = need.join(p.withColumnRenamed("g", "low").withColumnRenamed("p", "below"), suffix("g", k - 1) == F.col("low")), F.col("below")
            p = materialise(need.select("g", (F.coalesce(F.col("p"), F.lit(0.0)) + F.coalesce("w", F.lit(1.0)) * lower).alias("p")), f"quality-p{k}")
        return p.select("g", (-F.log2(F.greatest("p", F.lit(1e-12)))).alias("bits"))


def costs(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row (not the text), chars, and bits: what the whole text costs for each character (null where
    there is none). Texts travel once, compressed, to the chunk that they are dealt to by hash."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = int(size // CHUNK + 1)
    fields = {f.name: f for f in docs.select(*keep).schema.fields}
    schema = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in fields.items())
    dealt = docs.select(*keep, "text", F.pmod(F.xxhash64(*row_key(docs)[1:]), F.lit(n)).cast("int").alias("chunk"))

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "chunk")), pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in values(batch.column("text"))], pa.binary())], [*keep, "chunk", "packed"])

    def texts(packed: pa.ChunkedArray | pa.Array) -> Iterator[str]:
        unpack = zstandard.ZstdDecompressor().decompress
        return (unpack(x).decode("utf-8", "surrogatepass") for x in values(packed))

    def every(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.empty(0, np.int64)
        for batch in batches:
            for group in chunks(values(batch.column("text"))):
                found = np.union1d(found, Grams(group).different())
        yield pa.RecordBatch.from_arrays([pa.array(found)], ["g"])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            for c in np.unique(chunk):
                for group in chunks(texts(batch.column("packed").filter(pa.array(chunk == c)))):
                    new = Grams(group).different()
                    asked[int(c)] = np.union1d(asked[int(c)], new) if int(c) in asked else new
        for c, g in asked.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), c, np.int32)), pa.array(g)], ["chunk", "g"])

    def add(rows: pa.Table, told: pa.Table) -> pa.Table:
        grams, bits = told["g"].to_numpy(), told["bits"].to_numpy()
        sums, sizes = [], []
        for group in chunks(texts(rows["packed"])):
            g = Grams(group)
            sums.append(g.summed(grams, bits))
            sizes.append(g.sizes)
        total, chars = np.concatenate(sums), np.concatenate(sizes)
        give_back()
        mean = np.divide(total, chars, out=np.zeros(len(total)), where=chars > 0)
        return rows.select(keep).append_column("chars", pa.array(chars)).append_column("bits", pa.array(mean, mask=chars == 0))

    bits = model.cost(materialise(docs.select("text").mapInArrow(lean(every), "g long").distinct(), "quality-grams"))
    # One exchange serves both what the chunks ask and what they are told.
    squeezed = dealt.mapInArrow(lean(squeeze), f"{schema}, chunk int, packed binary").repartition(min(n, PARTS), "chunk")
    told = squeezed.mapInArrow(lean(ask), "chunk int, g long").join(bits, "g")
    return squeezed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(add, f"{schema}, chars long, bits double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as good. Repeated labels of one document count once."""
    return materialise(labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("__tg_good")).where("__tg_good IS NOT NULL").distinct(), "trusted-ids")


def _counted(rows: DataFrame, value: Column) -> dict[str | None, dict[int, int]]:
    """How many documents of each language fall into each bin: at most log2(1e12) / BIN bins a language."""
    by: dict[str | None, dict[int, int]] = {}
    for r in rows.groupBy("lang", F.round(value / BIN).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        by.setdefault(r["lang"], {})[r["bin"]] = r["n"]
    return by


def _quantiles(by: dict[str | None, dict[int, int]], q: float) -> tuple[dict[str | None, float], float]:
    """Of each language with LEAST documents, and of all documents together. Exact to one bin."""
    every: dict[int, int] = {}
    for x in by.values():
        for b, n in x.items():
            every[b] = every.get(b, 0) + n

    def at(x: dict[int, int]) -> float:
        due = q * sum(x.values())
        for b in sorted(x):
            due -= x[b]
            if due <= 0:
                return b * BIN
        return float("inf")

    return {k: at(x) for k, x in by.items() if sum(x.values()) >= LEAST}, at(every)


def _by_language(values: dict[str | None, float], rest: float) -> Column:
    out = F.lit(rest)
    for lang, x in values.items():
        out = F.when(F.col("lang").eqNullSafe(F.lit(lang)), x).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """KEY, doc_id, lang, bits (per character), score, limit and keep of every row of ``docs``.

    The score is the bits per character, drawn towards the median of the language by as much as the text is short.
    A null or empty text has no perplexity and is rejected. A language (or null) with fewer than LEAST trusted
    documents is held to the median and threshold of all trusted text. Without trusted text nothing but empty texts
    is rejected. Rows are judged one by one, so repeated rows and ids get equal verdicts; an empty table gives an empty result.
    """
    good = trusted_ids(labels)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"), *row_key(docs))
    trusted = rows.where("text IS NOT NULL").join(small(good), F.col("doc_id") == F.col("__tg_good"), "left_semi")
    scored = materialise(costs(rows, Model(trusted), ["doc_id", "lang", *KEY]), "quality-bits")
    seen = scored.where("bits IS NOT NULL").join(small(good), F.col("doc_id") == F.col("__tg_good"), "left_semi")
    middle = _by_language(*_quantiles(_counted(seen, F.col("bits")), 0.5))
    drawn = F.when(middle == float("inf"), F.col("bits")).otherwise(middle + (F.col("bits") - middle) * F.col("chars") / (F.col("chars") + SHRINK))
    limits, rest = _quantiles(_counted(seen, drawn), QUANTILE)
    limit = _by_language({k: x + MARGIN for k, x in limits.items()}, rest + MARGIN)
    scored = scored.withColumn("score", drawn).withColumn("limit", limit)
    return scored.withColumn("keep", F.coalesce(F.col("score") <= F.col("limit"), F.lit(False)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, lang, bits (per character), perplexity, score, limit (bits), keep."""
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "score", "limit", "keep")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, see ``judged``; columns as they came."""
    return without(docs, materialise(judged(docs, labels).where("NOT keep").select(*KEY).distinct(), "quality-gone"))
