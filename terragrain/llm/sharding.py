"""Sharding through fixed virtual slots.

Every record hashes into one of ``n_slots`` slots, for good. A versioned map says which shard holds each
slot; rebalancing edits the map by moving slots from the fullest to the emptiest shard, so only the records of
moved slots travel.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ._shared import materialise, shared_dir, table

N_SLOTS = 4096
#: Parts of a slot whose rows are numbered by different tasks.
SUBS = 16


@dataclass
class SlotMap:
    """Version, number of shards, and the shard of each slot."""

    version: int
    n_shards: int
    shards: list[int] = field(default_factory=list)

    @classmethod
    def initial(cls, n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        return cls(0, n_shards, [s % n_shards for s in range(n_slots)])

    def loads(self, weight: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for s, shard in enumerate(self.shards):
            out[shard] += weight[s]
        return out

    def rebalance(self, weight: list[int], n_shards: int | None = None) -> SlotMap:
        """The next version: while a move or a swap narrows the gap between the fullest and the emptiest shard, make it."""
        n = n_shards or self.n_shards
        shards = [x % n for x in self.shards]  # with fewer shards than before, those that go are dealt over the others
        have: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for s, shard in enumerate(shards):
            if weight[s]:
                insort(have[shard], (weight[s], s))
        load = [sum(w for w, _ in x) for x in have]
        while n > 1:
            hi, lo = max(range(n), key=lambda k: (load[k], -k)), min(range(n), key=lambda k: (load[k], k))
            gap = load[hi] - load[lo]
            best: tuple[int, tuple[int, int], tuple[int, int] | None] | None = None
            for out in [None, *have[lo]]:
                want = gap // 2 + (out[0] if out else 0)
                at = bisect_left(have[hi], (want, -1))
                for mine in have[hi][max(0, at - 1) : at + 1]:
                    moved = mine[0] - (out[0] if out else 0)
                    if 0 < moved < gap and (best is None or abs(gap - 2 * moved) < best[0]):
                        best = (abs(gap - 2 * moved), mine, out)
                if best and best[0] <= 1:
                    break
            if best is None:
                break
            for item, a, b in ((best[1], hi, lo), (best[2], lo, hi)):
                if item:
                    have[a].remove(item)
                    insort(have[b], item)
                    load[a] -= item[0]
                    load[b] += item[0]
                    shards[item[1]] = b
        return SlotMap(self.version + 1, n, shards)

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("map_version", T.IntegerType())])
        return spark.createDataFrame([(s, x, self.version) for s, x in enumerate(self.shards)], schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON per version, under ``path``/version=N; earlier versions stay readable."""
        row = json.dumps({"version": self.version, "n_shards": self.n_shards, "shards": self.shards})
        spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        return cls(**json.loads(spark.read.text(f"{path}/version={version}").select("value").first()[0]))

    @classmethod
    def latest(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The stored map of the highest version, None where there is none."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(at):
            return None
        r = spark.read.text(path).select("version", "value").orderBy(F.desc("version")).first()
        return cls(**json.loads(r["value"])) if r else None


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every row into one of ``n_shards`` shards whose bytes come out near equal (law ``bytes``).

    One row per input row: doc_id, size (UTF-8 bytes + 1; a null text has none), text_crc32, law, shard,
    slot (place within the shard, gapless from 0), grown_shard (null under this law), virtual_slot,
    map_version. Rows are hashed by id, size and checksum, so null and repeated ids spread too, and so do the rows of a
    group of equal texts: a group may hold a large part of all bytes, and kept together it would make its shard uneven.
    Fully identical rows share a slot and take its places in any order, since nothing tells them apart. An empty
    table gives an empty result; other columns are ignored.

    The map is kept under ``map_path``, a version for each run: a later run starts from the last one with as many slots, so that
    only slots moved by its rebalancing change shards.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    h = F.xxhash64("doc_id", "size", "text_crc32")
    sub = F.pmod(F.shiftrightunsigned(h, 32), F.lit(SUBS)).cast("int")
    base = materialise(base.select("*", F.pmod(h, F.lit(n_slots)).cast("int").alias("virtual_slot"), sub.alias("sub")), "shard-rows")
    held = materialise(base.groupBy("virtual_slot", "sub").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")), "shard-slots")  # n_slots * SUBS rows at most
    weight, count = [0] * n_slots, [0] * n_slots
    for r in held.groupBy("virtual_slot").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect():  # n_slots rows at most
        weight[r["virtual_slot"]], count[r["virtual_slot"]] = r["b"], r["n"]
    path = map_path or f"{shared_dir(spark)}/terragrain/slot-map-{uuid.uuid4().hex}"
    first = SlotMap.latest(spark, path)
    if first is None or len(first.shards) != n_slots:
        first = SlotMap.initial(n_shards, n_slots)
        first.save(spark, path)
    final = first.rebalance(weight, n_shards)
    final.save(spark, path)
    start, at = [0] * n_slots, [0] * n_shards
    for s, x in enumerate(final.shards):
        start[s], at[x] = at[x], at[x] + count[s]
    offsets = spark.createDataFrame(list(enumerate(start)), "virtual_slot int, start long")
    slots = final.frame(spark).join(offsets, "virtual_slot")
    before = F.sum("n").over(Window.partitionBy("virtual_slot").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    # n_slots * SUBS rows, parameters
    slots = F.broadcast(held.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(slots), "virtual_slot").select("virtual_slot", "sub", "shard", "map_version", (F.col("start") + F.col("before")).alias("start")))
    place = Window.partitionBy("virtual_slot", "sub").orderBy("doc_id", "text_crc32", "size")
    return (
        base.withColumn("place", F.row_number().over(place).cast("long") - 1)
        .join(slots, ["virtual_slot", "sub"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
