"""Block-cyclic tiling: pixels to blocks, blocks to ranks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bins import PixelGrid


@dataclass(frozen=True)
class BlockScheme:
    """A grid of ``cols`` x ``rows`` blocks of b_cols x b_rows pixels, dealt to ``procs`` ranks in turn."""

    cols: int
    rows: int
    b_cols: int
    b_rows: int
    procs: int

    @classmethod
    def fit(cls, grid: PixelGrid, limit: int, procs: int) -> BlockScheme:
        """Nearly square blocks of at most ``limit`` pixels."""
        b_cols = math.isqrt(limit)
        b_rows = limit // b_cols
        return cls(math.ceil(grid.cols / b_cols), math.ceil(grid.rows / b_rows), b_cols, b_rows, procs)

    @property
    def count(self) -> int:
        return self.cols * self.rows

    def block_of(self, col: Column, row: Column) -> Column:
        return (F.floor(row / self.b_rows) * self.cols + F.floor(col / self.b_cols)).cast("long")

    def rank_of(self, block: Column) -> Column:
        return (block % self.procs).cast("int")

    def position_of(self, block: Column) -> tuple[Column, Column]:
        """(block column, block row)."""
        return block % self.cols, F.floor(block / self.cols).cast("long")

    def count_of(self, rank: int) -> int:
        return self.count // self.procs + (1 if rank < self.count % self.procs else 0)

    def blocks_of(self, spark: SparkSession, rank: int) -> DataFrame:
        return spark.range(rank, self.count, self.procs).withColumnRenamed("id", "block")

    def grid_of(self, grid: PixelGrid, block: int) -> PixelGrid:
        """The pixels of one block; blocks at the far edges are cut."""
        c, r = block % self.cols * self.b_cols, block // self.cols * self.b_rows
        return PixelGrid(min(self.b_cols, grid.cols - c), min(self.b_rows, grid.rows - r), grid.ox + c * grid.res_x, grid.oy - r * grid.res_y, grid.res_x, grid.res_y)


def assign_blocks(points: DataFrame, grid: PixelGrid, scheme: BlockScheme) -> DataFrame:
    """``points`` within the grid with their block and rank."""
    x, y = F.col("x"), F.col("y")
    out = points.where(grid.within(x, y)).withColumn("block", scheme.block_of(grid.col_of(x, y), grid.row_of(x, y)))
    return out.withColumn("rank", scheme.rank_of(F.col("block")))


def sort_by_block(points: DataFrame, grid: PixelGrid, scheme: BlockScheme) -> DataFrame:
    """Points dealt to partitions by rank, in order of their blocks within each."""
    return assign_blocks(points, grid, scheme).repartition(scheme.procs, "rank").sortWithinPartitions("block")


def divide_tasks(n: int, procs: int) -> list[range]:
    """Contiguous shares of n tasks; the first n mod procs of them are one longer."""
    out, at = [], 0
    for p in range(procs):
        k = n // procs + (1 if p < n % procs else 0)
        out.append(range(at, at + k))
        at += k
    return out
