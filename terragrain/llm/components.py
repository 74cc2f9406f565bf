"""Connected components by alternating large-star and small-star rounds, wholly distributed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialise


#: Edges that one task thins to a spanning forest.
PER_TASK = 100_000


def thinned(edges: DataFrame, n: int) -> DataFrame:
    """Edges (a > b) with the same components but no more of them than nodes, for each task's share of the ``n``: a task
    joins its edges up and gives each node's link to the least node that it has found for it."""

    def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        links = [(x, root(x)) for x in list(up) if up[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return edges.repartition(max(1, -(-n // PER_TASK))).mapInArrow(forest, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) in any direction -> (node, root): root is the least node of the component.

    The root itself and nodes without an edge do not appear. Rounds end when a round changes nothing; every round is written to the
    shared folder, so neither lineage nor the loss of an executor reaches back over rounds. Rounds grow with the logarithm
    of the longest path; should ``most_rounds`` not be enough, an error is raised and no half-finished result returned.
    """
    first = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    e = materialise(thinned(first, first.count()), "cc-thin")
    discard(first)
    seen = None
    for _ in range(most_rounds):
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if mark["n"] == 0 or (seen and tuple(mark) == seen):
            break
        seen = tuple(mark)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        before, e = e, materialise(small.select("x.a", "x.b").where("a <> b").distinct(), "cc")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
