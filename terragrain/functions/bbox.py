"""Three-dimensional boxes as struct columns of min and max points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box(min_x: Column, min_y: Column, min_z: Column, max_x: Column, max_y: Column, max_z: Column) -> Column:
    p = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    return F.struct(p(min_x, min_y, min_z).alias("min"), p(max_x, max_y, max_z).alias("max"))


def box_of(points: DataFrame, *by: str) -> DataFrame:
    """The box of all points, or of each group of them."""
    ends = [f(c) for f in (F.min, F.max) for c in "xyz"]
    return points.groupBy(*by).agg(box(*ends).alias("box"))


def valid(b: Column) -> Column:
    return (b["max"]["x"] > b["min"]["x"]) & (b["max"]["y"] > b["min"]["y"]) & (b["max"]["z"] > b["min"]["z"])


def centroid(b: Column) -> Column:
    return F.struct(*[((b["min"][c] + b["max"][c]) / 2).alias(c) for c in "xyz"])


def area(b: Column) -> Column:
    return (b["max"]["x"] - b["min"]["x"]) * (b["max"]["y"] - b["min"]["y"])


def intersect(a: Column, b: Column) -> Column:
    """In x and y; touching boxes intersect."""
    return (a["min"]["x"] <= b["max"]["x"]) & (a["max"]["x"] >= b["min"]["x"]) & (a["min"]["y"] <= b["max"]["y"]) & (a["max"]["y"] >= b["min"]["y"])


def subdivide(b: Column) -> Column:
    """Four boxes at the centroid, with their names: NW, NE, SW, SE. Heights stay."""
    cx, cy = (b["min"]["x"] + b["max"]["x"]) / 2, (b["min"]["y"] + b["max"]["y"]) / 2
    x = {"W": (b["min"]["x"], cx), "E": (cx, b["max"]["x"])}
    y = {"N": (cy, b["max"]["y"]), "S": (b["min"]["y"], cy)}
    z0, z1 = b["min"]["z"], b["max"]["z"]
    parts = [(v + h, x[h], y[v]) for v in "NS" for h in "WE"]
    return F.array(*[F.struct(F.lit(n).alias("quadrant"), box(p[0], q[0], z0, p[1], q[1], z1).alias("box")) for n, p, q in parts])
