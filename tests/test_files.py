"""Sources, sinks and the command line on generated files."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrain import cli
from terragrain.plans.job import Options, dense, grid, grid_spec
from terragrain.sinks import arc_header, grid_header, raster_lines, read_geotiff, write_geotiff, write_text
from terragrain.sources import expand_paths, las_headers, list_files, read_ascii, read_buckets, read_file_list, read_las, read_polygons
from terragrain.sources.bucket import dump_bucket
from terragrain.sources.filelist import share_files
from terragrain.sources.las import LasError, LasReader, parse_header, peek, read_las_binary, write_las
from terragrain.sources.shp import polygon_bytes


@pytest.fixture(scope="module")
def las_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("las")
    rng = np.random.default_rng(1)
    for n, (name, minor, fmt) in enumerate((("a.las", 2, 0), ("b.las", 2, 1), ("c.las", 4, 6))):
        pts = rng.integers(0, 1000, (500, 3)) / 10 + np.array([100.0 * n, 0, 0])
        attr = {"return_number": rng.integers(1, 4, 500), "return_count": np.full(500, 3), "classification": rng.integers(0, 31, 500), "intensity": rng.integers(0, 65536, 500)}
        write_las(str(d / name), pts, 0.1, minor, fmt, attr)
        np.savez(d / f"{name}.npz", pts=pts, **attr)
    return d


def test_las_round_trip(spark, las_dir):
    for name in ("a.las", "b.las", "c.las"):
        t = np.load(las_dir / f"{name}.npz")
        for df in (read_las(spark, str(las_dir / name), points_per_task=120), read_las_binary(spark, str(las_dir / name))):
            rows = df.orderBy("idx").toPandas()
            assert np.allclose(rows[["x", "y", "z"]].to_numpy(), t["pts"]) and len(rows) == 500
            for c in ("return_number", "return_count", "classification", "intensity"):
                assert (rows[c].to_numpy() == t[c]).all()


def test_las_pruning_and_union(spark, las_dir):
    paths = [str(las_dir / n) for n in ("a.las", "b.las", "c.las")]
    assert read_las(spark, paths, ["x", "y", "z"]).count() == 1500
    r = LasReader({"paths": "\n".join(paths), "bbox": "110,0,150,50", "columns": "x"})
    assert {p.header.file for p in r.partitions()} == {paths[1]}
    got = read_las(spark, paths, ["x", "y", "z"]).where((F.col("x") > 210) & (F.col("x") < 220)).count()
    assert got == read_las(spark, paths[2], ["x"]).where("x > 210 AND x < 220").count()
    h = las_headers(spark, paths).orderBy("file").collect()
    assert [x.points for x in h] == [500] * 3 and [x.version for x in h] == ["1.2", "1.2", "1.4"]
    assert h[1].min_x >= 100 and h[1].max_x <= 200


def test_las_refuses_damage(las_dir, tmp_path):
    data = (las_dir / "a.las").read_bytes()
    size = len(data)
    with pytest.raises(LasError, match="not a LAS"):
        parse_header(b"XXXX" + data[4:], size)
    with pytest.raises(LasError, match="version"):
        parse_header(data[:25] + b"\x03" + data[26:], size)
    with pytest.raises(LasError, match="do not hold"):
        parse_header(data, size - 7)
    with pytest.raises(LasError, match="do not hold"):
        parse_header(data, size + 20)
    assert parse_header(data, size + 20, strict=False).points == 500
    with pytest.raises(LasError, match="record length"):
        parse_header(data[:104] + b"\x09" + struct.pack("<H", 0) + data[107:], size)
    p = tmp_path / "low.las"
    p.write_bytes(b"lasf" + data[4:])
    assert peek(str(p)).points == 500


def test_ascii(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1,2,3\n4.5,5,6,extra\n7,x,9\n")
    got = sorted(tuple(r) for r in read_ascii(spark, str(tmp_path / "p.txt")).collect())
    assert got == [(4.5, 5.0, 6.0), (7.0, 0.0, 9.0)]


def test_lists(tmp_path, monkeypatch):
    for n in ("a.las", "b.las", "c.txt"):
        (tmp_path / n).write_text("")
    (tmp_path / "list").write_text("x.las  \n\ny.las\t\n")
    assert read_file_list(str(tmp_path / "list")) == ["x.las", "y.las"]
    monkeypatch.setenv("WHERE", str(tmp_path))
    assert expand_paths(["${WHERE}/*.las"]) == [str(tmp_path / "a.las"), str(tmp_path / "b.las")]
    assert list_files(str(tmp_path), "las", 1) == [str(tmp_path / "b.las")]
    assert share_files(list("abcde"), 2) == [["a", "b", "c"], ["d", "e"]]
    with pytest.raises(FileNotFoundError):
        expand_paths(["/nowhere/*.las"])


def test_shapefile(tmp_path):
    rings = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]], [[(9.0, 9.0), (10.0, 9.0), (9.0, 10.0), (9.0, 9.0)]]]
    p = tmp_path / "s.shp"
    p.write_bytes(polygon_bytes(rings))
    assert len(read_polygons(str(p))) == 6
    data = bytearray(p.read_bytes())
    data[32] = 3
    p.write_bytes(data)
    with pytest.raises(ValueError, match="polygon"):
        read_polygons(str(p))


def test_buckets(spark, tmp_path):
    pts = np.arange(30.0).reshape(10, 3)
    dump_bucket(str(tmp_path), 3, pts[:4])
    dump_bucket(str(tmp_path), 3, pts)
    got = read_buckets(spark, str(tmp_path)).orderBy("x").toPandas()
    assert (got[["x", "y", "z"]].to_numpy() == pts).all() and set(got.bucket) == {3}


@pytest.fixture(scope="module")
def small(spark):
    p = spark.createDataFrame([(0.0, 0.0, 1.25), (3.0, 0.5, 2.0), (3.0, 6.0, -4.0)], "x double, y double, z double")
    o = Options(1.0, 1.0, radius=1.0)
    spec = grid_spec(p, o)
    return grid(p, spec, o), spec


def matrix(nodes, spec, col):
    m = np.full((spec.gy, spec.gx), -9999.0)
    for r in dense(nodes, spec).collect():
        if r[col] is not None:
            m[spec.gy - 1 - r.j, r.i] = r[col]
    return m


def test_text_raster(small, tmp_path):
    nodes, spec = small
    for measure, col, shape in (("mean", "zmean", "{:f} "), ("den", "den", "{:.0f} ")):
        path = tmp_path / f"o.{measure}.asc"
        write_text(nodes, spec, measure, str(path))
        body = path.read_text()[len(arc_header(spec)) :]
        want = "".join("".join("-9999 " if v == -9999 else shape.format(v) for v in row) + "\n" for row in matrix(nodes, spec, col))
        assert body == want
    write_text(nodes, spec, "mean", str(tmp_path / "o.grid"), "grid")
    assert (tmp_path / "o.grid").read_text().startswith(grid_header(spec))
    assert raster_lines(nodes, spec, "mean").count() == spec.gy


@pytest.mark.parametrize("big", [True, False])
def test_geotiff(small, tmp_path, big):
    nodes, spec = small
    path = str(tmp_path / "o.tif")
    write_geotiff(nodes, spec, "mean", path, epsg=26910, big=big)
    data, tags = read_geotiff(path)
    assert (data == matrix(nodes, spec, "zmean").astype("f4")).all()
    assert tags[33550] == (1.0, 1.0, 0.0) and tags[33922][3:5] == (0.0, spec.gy * 1.0) and 26910 in tags[34735]
    write_geotiff(nodes, spec, "mean", path, big=big, transform=(1.0, 2.0, 0.0, 9.0, 0.0, 2.0))
    assert read_geotiff(path)[1][34264][:8] == (2.0, 0.0, 0.0, 1.0, 0.0, 2.0, 0.0, 9.0)
    with pytest.raises(ValueError):
        write_geotiff(nodes, spec, "mean", path, epsg=-1)


def test_cli(spark, las_dir, tmp_path, capsys):
    out = str(tmp_path / "dem")
    (tmp_path / "in").write_text(f"{las_dir}/a.las\n{las_dir}/b.las \n")
    assert cli.main(["-f", str(tmp_path / "in"), "-o", out, "--resolution", "20", "--mean", "--den", "--output_format", "tif", "--fill", "--fill_window_size", "5", "--fill_empty", "-t"]) == 0
    assert f"{out}.mean.tif" in capsys.readouterr().out
    data, _ = read_geotiff(f"{out}.mean.tif")
    assert data.shape[1] >= 10 and (data != -9999).all()
    shape = tmp_path / "s.shp"
    shape.write_bytes(polygon_bytes([[[(10.0, 10.0), (60.0, 10.0), (60.0, 60.0), (10.0, 10.0)]]]))
    assert cli.main(["-i", f"{las_dir}/a.las", "-o", out, "--resolution", "10", "--max", "--output_format", "arc", "--output_shape", str(shape), "--keep_class", "1", "2", "--first_returns"]) == 0
    for bad in (["-i", "a", "-o", "x", "--resolution", "0"], ["-i", "a", "-o", "x", "--epsg", "-5"], ["-i", "a"], ["-i", "a", "-f", "b", "-o", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    with pytest.raises(ValueError, match="overlap"):
        cli.main(["-i", f"{las_dir}/a.las", "-o", out, "--output_bbox", "900", "900", "950", "950"])
