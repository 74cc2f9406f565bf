"""Points to the lattice nodes within a radius: generated from each point, never joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import GridSpec


def node_of(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Cell (i, j) of each point and the residual within it."""
    out = points.withColumn("xr", F.col("x") - spec.min_x).withColumn("yr", F.col("y") - spec.min_y)
    out = out.withColumn("i", F.floor(F.col("xr") / spec.dx).cast("int")).withColumn("j", F.floor(F.col("yr") / spec.dy).cast("int"))
    return out.withColumn("rx", F.col("xr") - F.col("i") * spec.dx).withColumn("ry", F.col("yr") - F.col("j") * spec.dy)


def stencil(points: DataFrame, spec: GridSpec, radius: float, keep: list[str] | None = None) -> DataFrame:
    """(i, j, z, d2, kept columns): every node with d2 <= radius * radius, clipped to the grid.

    One explode per point over the nodes of its bounding square; the exact test follows inside the same
    generated code. Rows grow by about pi r^2 / (dx dy) before partial aggregation shrinks them again.
    """
    keep = keep or []
    xr, yr = F.col("x") - F.lit(spec.min_x), F.col("y") - F.lit(spec.min_y)
    # One node wider than the quotient says: rounding must not lose a node that lies exactly on the circle.
    i0 = F.greatest(F.ceil((xr - radius) / spec.dx) - 1, F.lit(0)).cast("int")
    i1 = F.least(F.floor((xr + radius) / spec.dx) + 1, F.lit(spec.gx - 1)).cast("int")
    j0 = F.greatest(F.ceil((yr - radius) / spec.dy) - 1, F.lit(0)).cast("int")
    j1 = F.least(F.floor((yr + radius) / spec.dy) + 1, F.lit(spec.gy - 1)).cast("int")
    p = points.select("z", *keep, xr.alias("__x"), yr.alias("__y"), i0.alias("__i0"), (i1 - i0 + 1).alias("__ni"), j0.alias("__j0"), (j1 - j0 + 1).alias("__nj"))
    p = p.where("__ni > 0 AND __nj > 0").withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__ni") * F.col("__nj") - 1)))
    p = p.withColumn("i", F.col("__i0") + F.col("__k") % F.col("__ni")).withColumn("j", F.col("__j0") + F.expr("__k div __ni").cast("int"))
    ex, ey = F.col("__x") - F.col("i") * F.lit(spec.dx), F.col("__y") - F.col("j") * F.lit(spec.dy)
    return p.withColumn("d2", ex * ex + ey * ey).where(F.col("d2") <= F.lit(radius * radius)).select("i", "j", "z", "d2", *keep)
