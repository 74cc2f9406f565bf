"""Geometry of points, as column expressions over x, y, z of one point and x2, y2, z2 of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

P = tuple[Column, Column, Column]


def magnitude(a: P) -> Column:
    return F.sqrt(dot(a, a))


def dot(a: P, b: P) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def distance(a: P, b: P) -> Column:
    d = tuple(p - q for p, q in zip(a, b))
    return magnitude(d)


def altitude(a: P, b: P, strict: bool = True) -> Column:
    """Angle of elevation in degrees. ``strict`` keeps the historical base dx*x + dz*z, whose negative values give NaN;
    otherwise the base is the true length in x and z."""
    dx, dy, dz = (p - q for p, q in zip(a, b))
    base = dx * a[0] + dz * a[2] if strict else dx * dx + dz * dz
    root = F.when(base >= 0, F.sqrt(base)).otherwise(F.lit(float("nan")))
    return F.degrees(F.atan2(dy, root))


def slope(a: P, b: P) -> Column:
    """Rise from a to b over their distance; NULL between equal points."""
    d = distance(a, b)
    return F.when(d != 0, (b[2] - a[2]) / d)


def azimuth(a: P, b: P) -> Column:
    dx, _, dz = (p - q for p, q in zip(a, b))
    return F.degrees(F.atan2(-dx, -dz))


def quadrant(a: P, b: P) -> Column:
    """0 to 3: whether b lies right of a, plus 2 if above."""
    return F.when(b[0] > a[0], 1).otherwise(0) + F.when(b[1] > a[1], 2).otherwise(0)


def random_points(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Whole-numbered points with x in [-180, 180), y in [-90, 90), z in [-12500, 0)."""
    part = lambda k, lo, size: (F.floor(F.rand(seed + k) * size) + lo).cast("double")
    return spark.range(n).select(F.col("id").alias("pid"), part(0, -180, 360).alias("x"), part(1, -90, 180).alias("y"), part(2, -12500, 12500).alias("z"))
