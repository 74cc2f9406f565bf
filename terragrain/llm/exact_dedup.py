"""Exact dedup by an extendible-hash index kept in shared files.

A record's 64-bit hash addresses a directory by its leading bits. Buckets that hold more distinct hashes
than ``bucket_rows`` are split on the next bit, and the directory doubles whenever a bucket is already as
deep as the directory. Equal neighbours of the directory are kept as one entry, so its size is that of the buckets however deep
one of them is. Buckets are numbered in the order of their hashes and the index file is written in key ranges: each owner
task receives whole buckets and numbers the chain of different texts that collide on one hash. Texts are told apart by comparing
their bytes, never by the hash; a hash that one row has needs no comparison, so only texts of repeated hashes travel.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, discard, lower_ascii, materialise, small, table

#: Buckets of the directory, about: where there are more hashes than these can hold at ``bucket_rows``, buckets are larger.
MOST_BUCKETS = 1 << 20
#: Bits by which the counts behind a bucket that is still too full are refined.
FINER = 8

#: Counts of distinct hashes by their leading ``depth`` bits, below the given prefixes of ``above`` bits (None: all).
Counts = Callable[[int, int, "list[int] | None"], dict[int, int]]


class Directory:
    """The directory of an extendible hash: its global depth, and its buckets as (prefix, local depth) in key order."""

    def __init__(self) -> None:
        self.depth = 0
        self.buckets: list[tuple[int, int]] = [(0, 0)]

    @classmethod
    def build(cls, counts: Counts, capacity: int, at_first: int) -> Directory:
        """Split while a bucket holds more than ``capacity`` hashes; equal hashes cannot be split and chain."""
        out, todo, fine, above = cls(), [(0, 0)], at_first, 0
        done: list[tuple[int, int]] = []
        while todo:
            n = counts(fine, above, [p for p, _ in todo] if above else None)
            keys = sorted(n)
            upto = [0]
            for k in keys:
                upto.append(upto[-1] + n[k])
            still = []
            while todo:
                prefix, d = todo.pop()
                low, high = prefix << (fine - d), (prefix + 1) << (fine - d)
                if upto[bisect_left(keys, high)] - upto[bisect_left(keys, low)] <= capacity or d == 64:
                    done.append((prefix, d))
                elif d == fine:
                    still.append((prefix, d))
                else:
                    out.depth = max(out.depth, d + 1)  # doubles if the bucket is as deep as the directory
                    todo += [(prefix * 2, d + 1), (prefix * 2 + 1, d + 1)]
            todo, above, fine = still, fine, min(64, fine + FINER)
        out.buckets = sorted(done, key=lambda b: b[0] << (64 - b[1]))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """(bits, prefix, bucket): one row a bucket; a prefix of 64 bits is a signed long, as hashes are."""
        rows = [(d, p - (1 << 64) if p >> 63 else p, k) for k, (p, d) in enumerate(self.buckets)]
        return spark.createDataFrame(rows, "bits int, prefix long, bucket int")

    def look_up(self, rows: DataFrame, entries: DataFrame) -> DataFrame:
        """``rows`` (with a column h) and their bucket. Local depths are few, and each row has one prefix of each."""
        depths = sorted({d for _, d in self.buckets})
        prefix = {d: F.shiftrightunsigned("h", 64 - d) if d else F.lit(0).cast("long") for d in depths}
        keys = F.array(*[F.struct(F.lit(d).alias("bits"), prefix[d].alias("prefix")) for d in depths])
        return rows.withColumn("k", F.explode(keys)).select(*rows.columns, "k.bits", "k.prefix").join(small(entries), ["bits", "prefix"]).drop("bits", "prefix")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4096) -> DataFrame:
    """Groups of rows whose texts are equal after lower-casing A-Z.

    One row per input row: id, keep_id (largest id of the group), group_size, kept, text_sha256.
    A null text counts as empty. A null id never wins over another id; in a group of null ids alone keep_id
    is null and kept is false for none of them but true: they are indistinguishable. Rows that repeat the
    winning id are all marked kept. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), lower_ascii(F.coalesce(docs[text_col], F.lit(""))).alias("norm"))
    keyed = keyed.withColumn("h", F.xxhash64("norm"))
    entries = materialise(keyed.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-entries")
    hashes = materialise(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"), F.max("sha").alias("sha")), "exact-hashes")
    total = hashes.count()
    capacity = max(bucket_rows, total // MOST_BUCKETS)

    def counts(depth: int, above: int, prefixes: list[int] | None) -> dict[int, int]:
        some = hashes if prefixes is None else hashes.where(F.shiftrightunsigned("h", 64 - above).isin([p - (1 << 64) if p >> 63 else p for p in prefixes]))
        rows = some.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("p")).count().collect()  # about four for each bucket
        return {r["p"] % (1 << 64): r["count"] for r in rows}

    directory = Directory.build(counts, capacity, min(64, max(1, (total // capacity).bit_length() + 2)))
    buckets = materialise(directory.frame(spark), "exact-directory")

    # The keys of this aggregation are the texts themselves: equal hashes are chained, and bytes decide.
    repeated = materialise(hashes.where("n > 1").select("h"), "exact-repeated")
    texts = keyed.join(small(repeated), "h", "left_semi").groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    texts = texts.unionByName(hashes.where("n = 1").select("h", "sha", "keep_id", F.col("n").alias("group_size")))
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    chain = Window.partitionBy("bucket", "h").orderBy("sha")
    twin = F.lag("sha").over(chain) == F.col("sha")
    index = directory.look_up(texts, buckets).repartitionByRange(owners, "bucket").select(
        "*", F.row_number().over(chain).alias("chain"), F.when(twin, F.raise_error(F.lit("two texts share both hashes"))).cast("string").alias("clash")
    )
    index = materialise(index, "exact-index").select("bucket", "h", "sha", "keep_id", "group_size")
    # Both sides are narrow; AQE splits the partition of a group that holds a large part of all rows.
    found = directory.look_up(entries, buckets).join(index, ["bucket", "h", "sha"])
    discard(hashes, repeated)
    return found.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, max(doc_id) OVER w IS NULL) AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
