"""The gridding plan against loops over points and nodes, on tiny clouds."""

from __future__ import annotations

import math

import numpy as np
import pytest

from terragrain.operators.fill import row_fill, row_fill_strict, window_fill
from terragrain.operators.polygon import in_polygon, segments_of
from terragrain.plans.job import Options, dense, grid, grid_spec
from terragrain.spec import GridSpec, default_radius, float32, pick_measures


def cloud(spark, pts):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "pid long, x double, y double, z double")


def brute(pts, spec, r):
    out = {}
    for i in range(spec.gx):
        for j in range(spec.gy):
            near = [(z, (x - spec.min_x - i * spec.dx) ** 2 + (y - spec.min_y - j * spec.dy) ** 2) for x, y, z in pts if spec.min_x <= x <= spec.max_x and spec.min_y <= y <= spec.max_y]
            near = [(z, d) for z, d in near if d <= r * r]
            if near:
                zs = [z for z, _ in near]
                on = [z for z, d in near if d == 0]
                idw = on[0] if on else sum(z / d for z, d in near) / sum(1 / d for _, d in near)
                out[i, j] = (min(zs), max(zs), sum(zs) / len(zs), idw, len(zs), float(np.std(zs)))
    return out


CLOUDS = {
    "on_node": [(0, 0, 5), (12, 12, 7)],
    "coincident": [(0, 0, 1), (0, 0, 9), (5, 5, 3)],
    "single": [(3, 4, 2)],
    "negative": [(-50, -40, -1), (-44, -31.5, -3), (-47, -35, 2)],
    "random": np.random.default_rng(3).uniform(0, 40, (60, 3)).tolist(),
}


@pytest.mark.parametrize("name", CLOUDS)
def test_measures(spark, name):
    pts = CLOUDS[name]
    p = cloud(spark, pts)
    o = Options(6.0, 6.0, order="pid")
    spec = grid_spec(p, o)
    want = brute(pts, spec, default_radius(6.0))
    got = {(r.i, r.j): (r.zmin, r.zmax, r.zmean, r.zidw, r.den, r.zstd) for r in grid(p, spec, o).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_partitioning_and_order_do_not_matter(spark):
    pts = CLOUDS["random"]
    p = cloud(spark, pts)
    spec = GridSpec.from_bbox((0.0, 0.0, 40.0, 40.0), 4.0)
    o = Options(4.0, 4.0)
    a = {(r.i, r.j): r.zmean for r in grid(p, spec, o).collect()}
    b = {(r.i, r.j): r.zmean for r in grid(p.repartition(7).orderBy("z"), spec, o).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_points_outside_the_box_never_count(spark):
    p = cloud(spark, [(-0.5, 0, 100), (1, 1, 5)])
    spec = GridSpec.from_bbox((0.0, 0.0, 10.0, 10.0), 5.0)
    assert {r.zmax for r in grid(p, spec, Options(5.0, 5.0)).collect()} == {5.0}


def nodes_of(spark, values):
    return spark.createDataFrame([(i, j, float(v), 1) for (i, j), v in values.items()], "i int, j int, zmean double, den long")


@pytest.mark.parametrize("size,reached", [(3, 9), (5, 25), (7, 49)])
def test_window_fill_reach(spark, size, reached):
    spec = GridSpec(0.0, 0.0, 10.0, 10.0, 1.0, 1.0)
    out = window_fill(nodes_of(spark, {(5, 5): 3.5}), spec, size).collect()
    assert len(out) == reached and all(r.zmean == pytest.approx(3.5) for r in out)
    assert sorted(r.den for r in out) == [0] * (reached - 1) + [1] and sum(r.filled for r in out) == reached - 1


def test_window_fill_weights(spark):
    spec = GridSpec(0.0, 0.0, 10.0, 10.0, 1.0, 1.0)
    out = {(r.i, r.j): r.zmean for r in window_fill(nodes_of(spark, {(4, 5): 2.0, (7, 5): 10.0}), spec, 5).collect()}
    assert out[5, 5] == pytest.approx((2 + 10 / 4) / (1 + 1 / 4))
    with pytest.raises(ValueError):
        window_fill(nodes_of(spark, {(1, 1): 1}), spec, 4)


def strict_row(cells: dict[int, float], gx: int) -> dict[int, float]:
    """The overwriting row fill, step by step over one row."""
    out, begin, first = dict(cells), 0, True
    for i in range(gx):
        if i in cells and begin < i:
            for n, k in enumerate(range(begin, i), 1):
                out[k] = cells[i] if first else cells[begin - 1] + (cells[i] - cells[begin - 1]) * n / (i - begin + 1)
            begin, first = i + 1, False
    if gx - 1 not in cells and 0 < begin < gx:
        for k in range(begin, gx):
            out[k] = cells[begin - 1]
    return out


@pytest.mark.parametrize("row", [{0: 1, 1: 2, 2: 4, 3: 8}, {1: 5, 4: 8}, {0: 3}, {9: 7}, {}, {2: 1, 3: 9, 7: 4, 8: 2}])
def test_row_fill_strict(spark, row):
    spec = GridSpec(0.0, 0.0, 9.0, 1.0, 1.0, 1.0)
    row = {k: float(v) for k, v in row.items()}
    nodes = nodes_of(spark, {(i, 0): v for i, v in row.items()} | {(0, 1): 1.0})
    got = {r.i: r.zmean for r in row_fill_strict(nodes, spec).where("j = 0").collect()}
    assert got == pytest.approx(strict_row(row, spec.gx))


def clean_row(cells: dict[int, float], gx: int) -> dict[int, float]:
    """The row fill that changes empty nodes only: what each node of one row holds."""
    out = {}
    for i in range(gx if cells else 0):
        a, b = max((k for k in cells if k <= i), default=None), min((k for k in cells if k >= i), default=None)
        lo, hi = cells[b if a is None else a], cells[a if b is None else b]
        out[i] = lo if a is None or b is None or a == b else lo + (hi - lo) * (i - a) / (b - a)
    return out


@pytest.mark.parametrize("mask", [None, {(i, j) for i in range(6, 10) for j in range(8)}])
def test_window_then_row_fill(spark, mask):
    """A row without a populated node is empty, also where a window has filled some of it; nodes of the mask stay as they are."""
    spec = GridSpec(0.0, 0.0, 9.0, 7.0, 1.0, 1.0)
    values = {(2, 0): 1.0, (5, 0): 7.0, (7, 1): 4.0, (0, 4): 3.0, (9, 5): 8.0, (4, 5): 2.0}  # rows 2, 3, 6 and 7 have none
    window = window_fill(nodes_of(spark, values), spec, 3)
    near = {(r.i, r.j): r.zmean for r in window.collect()}
    assert {j for _, j in near} == set(range(7))
    outside = None if mask is None else spark.createDataFrame(sorted(mask), "i int, j int")
    out = row_fill(window, spec, outside).collect()
    want = {(i, j): v for j in range(spec.gy) for i, v in clean_row({i: v for (i, k), v in values.items() if k == j}, spec.gx).items() if (i, j) in values or (i, j) not in (mask or ())}
    want |= {k: v for k, v in near.items() if k in (mask or ())}
    assert len(out) == len(want) and {(r.i, r.j): r.zmean for r in out} == pytest.approx(want)
    assert {(r.i, r.j): (r.den, r.filled) for r in out} == {k: (int(k in values), k not in values) for k in want}


def test_polygon_on_edges_and_holes(spark):
    square = segments_of([[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]])
    pts = [(3, 3, 0), (1.5, 1.5, 0), (5, 1, 0), (-1, 1, 0), (0.5, 1.0, 0), (3.0, 2.0, 0)]
    want = [True, False, False, False, True, True]
    for strips in (None, 3):
        got = {r.pid: r.inside for r in in_polygon(cloud(spark, pts), square, strips=strips).collect()}
        assert [got[k] for k in range(len(pts))] == want
    twice = square[:4] * 2
    assert not any(r.inside for r in in_polygon(cloud(spark, pts), twice).collect())
    assert not any(r.inside for r in in_polygon(cloud(spark, pts), []).collect())


def test_spec():
    s = GridSpec(0.0, 0.0, 10.0, 4.0, 3.0, 2.0)
    assert (s.gx, s.gy) == (5, 3)
    assert float32(0.1) == pytest.approx(0.1, rel=1e-7) and float32(0.1) != 0.1
    assert pick_measures(["std", "min"]) == ["min", "std"] and len(pick_measures()) == 6 and len(pick_measures(["all", "min"])) == 6
    assert default_radius(6.0) == math.sqrt(2) * 6
    for bad in ((1.0, 0.0, 1.0, 2.0), (0.0, 5.0, 1.0, 2.0)):
        with pytest.raises(ValueError):
            GridSpec.from_bbox(bad, 1.0)
    with pytest.raises(ValueError):
        pick_measures(["median"])


def test_dense_covers_the_grid(spark):
    p = cloud(spark, CLOUDS["on_node"])
    o = Options(6.0, 6.0)
    spec = grid_spec(p, o)
    assert dense(grid(p, spec, o), spec).count() == spec.nodes
