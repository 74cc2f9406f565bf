"""Rasters and point files that tasks write themselves, against those of one writer."""

from __future__ import annotations

import os

import numpy as np
import pytest

from terragrain.functions.process import memory, worker_memory
from terragrain.operators.bins import PixelGrid, bin_mean
from terragrain.plans.job import Options, grid, grid_spec, run
from terragrain.sinks import read_geotiff, write_geotiff, write_pixels, write_text
from terragrain.sources import read_las
from terragrain.sources.las import extent_of, peek, write_las_tiles


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), float(y), float(z), int(c)) for x, y, z, c in zip(rng.integers(0, 4000, 800) / 10, rng.integers(0, 900, 800) / 10, rng.integers(-500, 500, 800) / 4, rng.integers(0, 31, 800))]
    return spark.createDataFrame(rows, "x double, y double, z double, classification int").cache()


def test_shared_rasters_are_the_same(cloud, tmp_path, monkeypatch):
    monkeypatch.setattr("terragrain.sinks.geotiff.STRIP_BYTES", 2000)
    o = Options(1.0, 1.0, radius=0.5, measures=["mean", "den"])
    spec = grid_spec(cloud, o)
    nodes = grid(cloud, spec, o).persist()
    for kind in ("arc", "grid"):
        for shared in (False, True):
            write_text(nodes, spec, "den", str(tmp_path / f"{kind}{shared}"), kind, shared)
        assert (tmp_path / f"{kind}True").read_bytes() == (tmp_path / f"{kind}False").read_bytes()
    for big in (False, True):
        for shared in (False, True):
            write_geotiff(nodes, spec, "mean", str(tmp_path / f"{big}{shared}"), 4326, big, shared=shared)
        assert (tmp_path / f"{big}True").read_bytes() == (tmp_path / f"{big}False").read_bytes()


def test_pixels(cloud, tmp_path):
    g = PixelGrid.of(cloud, 10.0, 20.0)
    bins = bin_mean(cloud, g).cache()
    write_pixels(bins, g, str(tmp_path / "p.tif"))
    data, tags = read_geotiff(str(tmp_path / "p.tif"))
    assert data.shape == (g.rows, g.cols) and tags[33550] == (10.0, 20.0, 0.0) and tags[33922][3:5] == (g.ox, g.oy)
    for r in bins.collect():
        assert data[r["row"], r["col"]] == np.float32(r["mean"])
    assert (data != -9999).sum() == bins.count()
    write_pixels(bins, g, str(tmp_path / "p.asc"), "arc")
    assert f"ncols {g.cols}\nnrows {g.rows}\n" in (tmp_path / "p.asc").read_text()


def test_las_tiles_and_parts(spark, cloud, tmp_path):
    files = write_las_tiles(cloud.repartition(3), str(tmp_path / "tiles"), 0.01, 4, 6)
    assert len(files) == 3 and sorted(os.listdir(tmp_path / "tiles")) == [os.path.basename(f) for f in files]
    back = read_las(spark, [f"file://{f}" for f in files], ["x", "y", "z", "classification"], points_per_task=100)
    key = lambda df: sorted(tuple(round(float(v), 2) for v in r) for r in df.select("x", "y", "z", "classification").collect())
    assert key(back) == key(cloud)
    n = peek(files[0]).points
    part = read_las(spark, files[0], ["x", "y", "z", "idx"], start=5, count=20, points_per_task=7)
    rows = part.collect()
    assert sorted(r.idx for r in rows) == list(range(5, 25)) and extent_of(part) == tuple(f(r[c] for r in rows) for f in (min, max) for c in "xyz")
    assert read_las(spark, files[0], ["x"], start=n - 3, count=50).count() == 3 and read_las(spark, files[0], ["x"], start=n + 1).count() == 0


def test_job_phases_and_overlap(spark, cloud, tmp_path):
    files, phases = run(spark, cloud, Options(10.0, 10.0, measures=["min"]), str(tmp_path / "o"), ("arc", "tif"), shared=True)
    assert [os.path.basename(f) for f in files] == ["o.min.asc", "o.min.tif"] and list(phases.seconds) == ["extent", "plan", "process", "write", "total"]
    with pytest.raises(ValueError, match="overlap"):
        run(spark, cloud, Options(10.0, 10.0, bbox=(5000.0, 5000.0, 6000.0, 6000.0)), str(tmp_path / "x"))


def test_memory(spark):
    virtual, resident = memory()
    assert 0 < resident <= virtual and worker_memory(spark, 3).where("resident > 0").count() == 3
