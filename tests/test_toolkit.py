"""Points, boxes, blocks, pixel grids and coordinates against values worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from terragrain.functions import bbox, crs, dtypes, point
from terragrain.operators.bins import PixelGrid, bin_mean, first_points, sort_points
from terragrain.operators.blocks import BlockScheme, divide_tasks, sort_by_block
from terragrain.operators.filters import overlaps_open


def lit3(*v):
    return tuple(F.lit(float(x)) for x in v)


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_point_metrics(spark):
    a, b = lit3(10, 20, 30), lit3(5, 15, 25)
    r = one(spark, point.distance(a, b), point.altitude(a, b), point.azimuth(a, b), point.slope(a, b), point.quadrant(b, a), point.dot(a, b))
    assert tuple(r) == pytest.approx((8.660254, 19.4712, -135.0, -0.577350, 3, 1100.0), abs=1e-4)
    a, b = lit3(10, 10, 10), lit3(20, 20, 20)
    r = one(spark, point.distance(a, b), point.altitude(a, b), point.azimuth(a, b), point.slope(a, b), point.slope(a, a))
    assert r[0] == pytest.approx(17.320508) and math.isnan(r[1]) and r[2] == pytest.approx(45.0) and r[3] == pytest.approx(0.57735, abs=1e-5) and r[4] is None


def test_boxes(spark):
    b = bbox.box(*lit3(30, 40, -100), *lit3(60, 70, 50))
    r = one(spark, bbox.centroid(b), bbox.area(b), bbox.valid(b), bbox.intersect(b, bbox.box(*lit3(60, 70, 0), *lit3(61, 71, 1))), bbox.subdivide(b))
    assert (r[0].x, r[0].y) == (45.0, 55.0) and r[1] == 900.0 and r[2] and r[3]
    got = {q.quadrant: (q.box.min.x, q.box.min.y, q.box.max.x, q.box.max.y) for q in r[4]}
    assert got == {"NW": (30, 55, 45, 70), "NE": (45, 55, 60, 70), "SW": (30, 40, 45, 55), "SE": (45, 40, 60, 55)}
    assert not overlaps_open((0, 0, 1, 1), (1, 0, 2, 1)) and overlaps_open((0, 0, 1, 1), (0.9, 0.9, 2, 2))


def test_blocks(spark):
    s = BlockScheme.fit(PixelGrid(63_721_200, 28_081_200, 0.0, 0.0, 1.0, 1.0), 2_000_000, 200)
    assert (s.b_cols, s.b_rows, s.cols, s.rows, s.count) == (1414, 1414, 45_065, 19_860, 894_990_900)
    s = BlockScheme(3, 4, 10, 10, 5)
    assert sum(s.count_of(r) for r in range(5)) == 12 and [r.block for r in s.blocks_of(spark, 1).collect()] == [1, 6, 11]
    g = PixelGrid(25, 35, 0.0, 35.0, 1.0, 1.0)
    assert s.grid_of(g, 11).cols == 5 and s.grid_of(g, 11).rows == 5 and s.grid_of(g, 4).oy == 25.0
    assert [len(r) for r in divide_tasks(10, 4)] == [3, 3, 2, 2]


def test_pixels(spark):
    g = PixelGrid(1000, 1000, -142.0, 42.0, 1.0, 1.0)
    assert (g.max_x, g.min_y, g.cells) == (858.0, -958.0, 1_000_000)
    r = one(spark, g.col_of(F.lit(858.0), F.lit(42.0)), g.row_of(F.lit(858.0), F.lit(-958.0)), g.cell_of(F.lit(900.0), F.lit(0.0)), g.cell_of(F.lit(-141.5), F.lit(40.5)))
    assert tuple(r) == (999, 999, -1, 1000)
    p = spark.createDataFrame([(0.5, 0.5, 1.0), (0.6, 0.4, 4.0), (9.0, 9.0, 1.0)], "x double, y double, z double")
    got = bin_mean(p, PixelGrid(2, 2, 0.0, 2.0, 1.0, 1.0), single=True).collect()
    assert [(r["row"], r["col"], r["count"], r["mean"]) for r in got] == [(1, 0, 2, 2.5)]
    assert first_points(p, 1, ["x"]).count() == 1
    assert [r.x for r in sort_points(p, "x").collect()] == [0.5, 0.6, 9.0]
    assert sort_by_block(p, PixelGrid(10, 10, 0.0, 10.0, 1.0, 1.0), BlockScheme(2, 2, 5, 5, 3)).count() == 3


def test_coordinates(spark):
    p = point.random_points(spark, 2000, 7).select("x", "y", "z", crs.to_geocentric(F.col("x"), F.col("y"), F.col("z")).alias("g"))
    p = p.select("x", "y", "z", crs.to_geodetic(F.col("g.x"), F.col("g.y"), F.col("g.z")).alias("b"))
    away = F.greatest(F.abs(F.col("b.lat") - F.col("y")), F.when(F.col("y") > -90, F.abs(F.col("b.lon") - F.col("x")) % 360).otherwise(0.0))
    r = p.agg(F.max(away), F.max(F.abs(F.col("b.h") - F.col("z"))), F.count("b.h")).first()
    assert r[0] < 1e-6 and r[1] < 0.05 and r[2] == 2000
    r = one(spark, crs.to_geocentric(*lit3(0, 91, 0)), crs.to_geodetic(*lit3(0, 0, 0)), crs.to_geodetic(*lit3(0, 0, -6356752.3142)), crs.to_geocentric(*lit3(270, 0, 0)))
    assert r[0] is None and (r[1].lat, r[1].h) == (90.0, -crs.WGS84.b) and r[2].lat == -90.0 and abs(r[2].h) < 1e-3 and r[3].y == pytest.approx(-crs.WGS84.a)
    with pytest.raises(ValueError):
        crs.Ellipsoid(1.0, 2.0)


def test_dtypes():
    assert dtypes.size_of("Int16") == 2 and dtypes.spark_type("Float32") == "float" and len(dtypes.DTYPES) == 12 and dtypes.size_of("CInt16") == 2
