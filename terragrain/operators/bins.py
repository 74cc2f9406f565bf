"""Plain binning: one point, one pixel; rows count down from the upper left corner."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PixelGrid:
    """``cols`` x ``rows`` pixels of res_x x res_y from the upper left corner (ox, oy)."""

    cols: int
    rows: int
    ox: float
    oy: float
    res_x: float
    res_y: float

    @classmethod
    def over(cls, min_x: float, min_y: float, max_x: float, max_y: float, res: float, res_y: float | None = None) -> PixelGrid:
        res_y = res if res_y is None else res_y
        return cls(max(1, math.ceil((max_x - min_x) / res)), max(1, math.ceil((max_y - min_y) / res_y)), min_x, max_y, res, res_y)

    @classmethod
    def of(cls, points: DataFrame, res: float, res_y: float | None = None) -> PixelGrid:
        """Over the extent of the points: one aggregation, four numbers to the driver."""
        e = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        if e[0] is None:
            raise ValueError("no points")
        return cls.over(*e, res, res_y)

    @property
    def max_x(self) -> float:
        return self.ox + self.cols * self.res_x

    @property
    def min_y(self) -> float:
        return self.oy - self.rows * self.res_y

    @property
    def cells(self) -> int:
        return self.cols * self.rows

    def nbytes(self, pixel: int = 8) -> int:
        return self.cells * pixel

    def within(self, x: Column, y: Column) -> Column:
        """Closed on all sides."""
        return x.between(self.ox, self.max_x) & y.between(self.min_y, self.oy)

    def col_of(self, x: Column, y: Column) -> Column:
        """Column of a point, -1 outside; points on the far edge belong to the last pixel."""
        return F.when(self.within(x, y), F.least(F.floor((x - self.ox) / self.res_x), F.lit(self.cols - 1))).otherwise(-1).cast("int")

    def row_of(self, x: Column, y: Column) -> Column:
        return F.when(self.within(x, y), F.least(F.floor((self.oy - y) / self.res_y), F.lit(self.rows - 1))).otherwise(-1).cast("int")

    def cell_of(self, x: Column, y: Column) -> Column:
        return F.when(self.within(x, y), self.row_of(x, y).cast("long") * self.cols + self.col_of(x, y)).otherwise(-1)


def bin_mean(points: DataFrame, grid: PixelGrid, single: bool = False) -> DataFrame:
    """(row, col, count, mean): ``single`` sums in single precision like files of Float32 pixels."""
    x, y = F.col("x"), F.col("y")
    z = F.col("z").cast("float") if single else F.col("z")
    inside = points.where(grid.within(x, y)).select(grid.row_of(x, y).alias("row"), grid.col_of(x, y).alias("col"), z.alias("z"))
    return inside.groupBy("row", "col").agg(F.count(F.lit(1)).alias("count"), F.avg("z").alias("mean"))


def longest_axis(points: DataFrame) -> DataFrame:
    """One row: the extent of each axis and the number (0, 1, 2) of the longest, the first among equals."""
    e = points.agg(*[(F.max(c) - F.min(c)).alias(f"extent_{c}") for c in "xyz"])
    sizes = F.array(*[F.col(f"extent_{c}") for c in "xyz"])
    return e.withColumn("axis", (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int"))


def first_points(points: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """A bucket of bounded capacity: the first ``capacity`` points by ``order``."""
    return points.orderBy(*order).limit(capacity)


def sort_points(points: DataFrame, axis: str) -> DataFrame:
    """All points in order of one axis, ties by the others."""
    return points.orderBy(axis, *[c for c in "xyz" if c != axis])
