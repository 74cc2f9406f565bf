"""Registered queries that write files and read them back: point files, rasters, buckets, lists, streams, the command line.

The files lie in the folder that driver and executors share and go when the program ends.
"""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cli, queries
from .functions import crs, dtypes, point
from .functions.process import worker_memory
from .operators.bins import PixelGrid, bin_mean, first_points, sort_points
from .operators.stencil import node_of
from .plans import views
from .plans.job import Options, grid, grid_spec, run
from .queries import BOX, PIX_SQL, RINGS, SEGMENTS, grid_sql, pixels, register, rounded
from .sinks.geotiff import read_geotiff, write_geotiff
from .sinks.pixels import write_pixels
from .sinks.text import arc_header, grid_header, output_name, write_text, write_text_parts
from .sources import expand_paths, las_headers, list_files, read_ascii, read_buckets, read_file_list, read_las, read_polygons
from .sources.bucket import dump_bucket, write_buckets
from .sources.filelist import share_files
from .sources.las import LasError, extent_of, parse_header, read_las_binary, write_las_tiles
from .sources.shp import polygon_bytes
from .spec import NODATA, GridSpec
from .streaming.live import last_batch, live_grid, windowed_grid, write_batches

#: Points of the events table as point files hold them: two decimals, cut off alike in any engine.
CUT = "SELECT pid, x, floor(y * 100) / 100 AS y, floor(z * 100) / 100 AS z, classification, CAST(1 + pid % 3 AS SMALLINT) AS return_number, CAST(3 AS SMALLINT) AS return_count FROM evt"
CUT_SQL = f"WITH evt AS ({views.SQL['evt']}), src AS ({CUT})"
SIX = "round(min(x), 2) AS min_x, round(min(y), 2) AS min_y, round(min(z), 2) AS min_z, round(max(x), 2) AS max_x, round(max(y), 2) AS max_y, round(max(z), 2) AS max_z"


def workspace(spark: SparkSession) -> str:
    """A new folder for generated files, as a plain path: in spark.checkpoint.dir, or a temporary one for a session of one
    process. A folder that is not a plain path is refused, since rasters are written by seeking."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if "cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.gettempdir()
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{path} is not a folder that can be mounted")
    path = os.path.join(path, f"terragrain-files-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.event_points(spark, sf_dir)
    cut = lambda c: (F.floor(F.col(c) * 100) / 100).alias(c)
    return p.select("pid", "x", cut("y"), cut("z"), "classification", (1 + F.col("pid") % 3).alias("return_number"), F.lit(3).alias("return_count"))


def las_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """One file for each class, points by pid; classes 1 and 2 as LAS 1.2, the others as 1.4."""
    p, folder, out = cut_points(spark, sf_dir), workspace(spark), []
    for c in sorted(views.EVENT_CLASS.values()):
        old = c < 3
        out += write_las_tiles(p.where(F.col("classification") == c).coalesce(1).sortWithinPartitions("pid"), f"{folder}/class{c}", 0.01, 2 if old else 4, 0 if old else 6)
    return out


def class_of(file: str) -> Column:
    return F.regexp_extract(file, r"class(\d)", 1).cast("int").alias("classification")


def _las() -> None:
    def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, p = workspace(spark), cut_points(spark, sf_dir).repartition(4, "pid")
        files = write_las_tiles(p.where("pid % 2 = 0"), f"{folder}/old", 0.01, 2, 0) + write_las_tiles(p.where("pid % 2 = 1"), f"{folder}/new", 0.01, 4, 6)
        return rounded(read_las(spark, files, ["x", "y", "z", "return_number", "return_count", "classification"], points_per_task=20_000), 2)

    register("las_scan", scan, f"{CUT_SQL} SELECT round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, return_number, return_count, CAST(classification AS SMALLINT) AS classification FROM src")

    def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(las_headers(spark, las_files(spark, sf_dir)), 2).withColumn("classification", class_of("file")).drop("file", "offset")

    register("las_headers", headers, f"""{CUT_SQL} SELECT CAST(classification AS INTEGER) AS classification, CASE WHEN classification < 3 THEN '1.2' ELSE '1.4' END AS version, CASE WHEN classification < 3 THEN 0 ELSE 6 END AS format,
  CASE WHEN classification < 3 THEN 20 ELSE 30 END AS stride, count(*) AS points, {SIX} FROM src GROUP BY classification""")

    def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = las_headers(spark, las_files(spark, sf_dir))
        return rounded(h.agg(*[F.min(f"min_{c}").alias(f"min_{c}") for c in "xyz"], *[F.max(f"max_{c}").alias(f"max_{c}") for c in "xyz"], F.sum("points").alias("points")), 2)

    register("las_extent", extent, f"{CUT_SQL} SELECT {SIX}, CAST(count(*) AS BIGINT) AS points FROM src")

    def part(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = las_files(spark, sf_dir)
        p = read_las(spark, files, ["x", "y", "z", "file"], start=10, count=50, points_per_task=20)
        e = extent_of(p)
        whole = [F.lit(round(v, 2)).alias(f"all_{k}_{c}") for v, (k, c) in zip(e, [(k, c) for k in ("min", "max") for c in "xyz"])]
        return rounded(p.groupBy(class_of("file")).agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("sum_x"), F.sum("z").alias("sum_z")), 2).select("*", *whole)

    everything = ", ".join(f"(SELECT round({k}({c}), 2) FROM p) AS all_{k}_{c}" for k in ("min", "max") for c in "xyz")
    register("las_subrange", part, f"""{CUT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY pid) AS k FROM src), p AS (SELECT * FROM n WHERE k BETWEEN 11 AND 60)
SELECT CAST(classification AS INTEGER) AS classification, count(*) AS points, round(sum(x), 2) AS sum_x, round(sum(z), 2) AS sum_z, {everything} FROM p GROUP BY classification""")

    def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = read_las(spark, las_files(spark, sf_dir), ["x", "y", "z", "file"], bbox=BOX).where(F.col("x").between(BOX[0], BOX[2]) & F.col("y").between(BOX[1], BOX[3]))
        return rounded(p.groupBy(class_of("file")).agg(F.count(F.lit(1)).alias("points"), F.sum("z").alias("sum_z")), 2)

    register("las_prune", prune, f"{CUT_SQL} SELECT CAST(classification AS INTEGER) AS classification, count(*) AS points, round(sum(z), 2) AS sum_z FROM src WHERE x BETWEEN {BOX[0]!r} AND {BOX[2]!r} AND y BETWEEN {BOX[1]!r} AND {BOX[3]!r} GROUP BY classification")

    def url(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = las_files(spark, sf_dir)
        ranged = read_las(spark, [f"file://{f}" for f in files], ["x", "z", "file"], points_per_task=5_000).withColumn("way", F.lit("ranges"))
        whole = read_las_binary(spark, f"file://{os.path.dirname(os.path.dirname(files[0]))}/*", ["x", "z", "file"]).withColumn("way", F.lit("whole"))
        return rounded(ranged.union(whole).groupBy("way", class_of("file")).agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("sum_x"), F.sum("z").alias("sum_z")), 2)

    register("las_url", url, f"{CUT_SQL} SELECT way, CAST(classification AS INTEGER) AS classification, count(*) AS points, round(sum(x), 2) AS sum_x, round(sum(z), 2) AS sum_z FROM src, (VALUES ('ranges'), ('whole')) w(way) GROUP BY way, classification")

    def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What is said of damaged copies of a file's header, by the size that goes with it."""
        file = las_files(spark, sf_dir)[0]
        size = os.path.getsize(file)
        with open(file, "rb") as f:
            data = f.read(375)
        rows = []
        for case, (bytes_, n, strict) in {"none": (data, size, True), "magic": (b"XXXX" + data[4:], size, True), "lower": (b"lasf" + data[4:], size, True), "version": (data[:25] + b"\x03" + data[26:], size, True), "short": (data, size - 1, True), "long": (data, size + 20, True), "long, lenient": (data, size + 20, False)}.items():
            try:
                parse_header(bytes_, n, "", strict)
                rows.append((case, True))
            except LasError:
                rows.append((case, False))
        return spark.createDataFrame(rows, "damage string, opens boolean")

    register("las_damage", refused, "SELECT * FROM (VALUES ('none', true), ('magic', false), ('lower', true), ('version', false), ('short', false), ('long', false), ('long, lenient', true)) t(damage, opens)")


def _sources() -> None:
    def text(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = workspace(spark)
        views.lineitem_points(spark, sf_dir).select("x", "y", "z", "classification").write.mode("overwrite").csv(f"file://{folder}/points", header=True)
        p = read_ascii(spark, f"file://{folder}/points")
        return rounded(p.groupBy("x", "y").agg(F.count(F.lit(1)).alias("points"), F.sum("z").alias("sum_z")), 2)

    register("ascii_scan", text, f"WITH src AS ({views.SQL['li']}) SELECT round(x, 2) AS x, round(y, 2) AS y, count(*) AS points, round(sum(z), 2) AS sum_z FROM src GROUP BY 1, 2")

    def files(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The ways to name files, over one name for each nation: folder slice, list, pattern with a variable, shares."""
        folder = workspace(spark)
        names = sorted(r["n_name"].strip().replace(" ", "_") for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").collect())
        for n in names:
            open(f"{folder}/{n}.las", "w").close()
            open(f"{folder}/{n}.txt", "w").close()
        with open(f"{folder}/list", "w") as f:
            f.write("".join(f"{folder}/{n}.las \t\n\n" for n in names))
        os.environ["TERRAGRAIN_FOLDER"] = folder
        ways = {"folder": list_files(folder, "las", 2, 7), "list": read_file_list(f"{folder}/list"), "pattern": expand_paths(["${TERRAGRAIN_FOLDER}/*1*.las"])}
        del os.environ["TERRAGRAIN_FOLDER"]
        rows = [(way, -1, os.path.basename(f)) for way, fs in ways.items() for f in fs]
        rows += [("share", k, os.path.basename(f)) for k, fs in enumerate(share_files([f"{n}.las" for n in names], 4)) for f in fs]
        return spark.createDataFrame(rows, "way string, share int, file string")

    register("file_names", files, """WITH n AS (SELECT replace(trim(n_name), ' ', '_') || '.las' AS file FROM nation), k AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS k, count(*) OVER () AS n FROM n)
SELECT 'folder' AS way, -1 AS share, file FROM k WHERE k BETWEEN 2 AND 6 UNION ALL SELECT 'list', -1, file FROM k UNION ALL SELECT 'pattern', -1, file FROM k WHERE file LIKE '%1%'
UNION ALL SELECT 'share', CAST(CASE WHEN k < (n % 4) * (n // 4 + 1) THEN k // (n // 4 + 1) ELSE (k - n % 4) // (n // 4) END AS INTEGER), file FROM k""")

    def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Binary buckets by label, dumped twice, and the same as Parquet."""
        p, folder = views.embedding_points(spark, sf_dir).withColumn("bucket", (F.col("pid") % 8).cast("int")), workspace(spark)
        write_buckets(p.select("bucket", "x", "y", "z"), f"file://{folder}/parquet")

        def dump(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            for part in (pdf.iloc[:1], pdf):  # the second replaces the first
                dump_bucket(f"{folder}/bkt", int(key[0]), part[["x", "y", "z"]].to_numpy())
            return pdf[["bucket"]].head(1)

        p.select("bucket", "x", "y", "z").groupBy("bucket").applyInPandas(dump, "bucket int").write.format("noop").mode("overwrite").save()
        both = read_buckets(spark, f"file://{folder}/bkt").withColumn("way", F.lit("binary")).unionByName(spark.read.parquet(f"file://{folder}/parquet").withColumn("way", F.lit("parquet")))
        return rounded(both.groupBy("way", "bucket").agg(F.count(F.lit(1)).alias("points"), *[F.sum(c).alias(f"sum_{c}") for c in "xyz"]), 4)

    register("bucket_scan", buckets, f"WITH src AS ({views.SQL['emb']}) SELECT way, CAST(pid % 8 AS INTEGER) AS bucket, count(*) AS points, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y, round(sum(z), 4) AS sum_z FROM src, (VALUES ('binary'), ('parquet')) w(way) GROUP BY 1, 2")

    def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{workspace(spark)}/s.shp"
        with open(path, "wb") as f:
            f.write(polygon_bytes([RINGS]))
        return spark.createDataFrame(read_polygons(path), "x1 double, y1 double, x2 double, y2 double")

    register("shape_segments", shape, f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(f'{v!r}::DOUBLE' for v in s) + ')' for s in SEGMENTS)}) t(x1, y1, x2, y2)")

    def random(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
        p = point.random_points(spark, n)
        inside = F.col("x").between(-180, 179) & F.col("y").between(-90, 89) & F.col("z").between(-12500, -1) & (F.col("x") == F.floor("x")) & (F.col("y") == F.floor("y")) & (F.col("z") == F.floor("z"))
        return p.agg(F.count(F.lit(1)).alias("points"), F.bool_and(inside).alias("inside"), (F.count_distinct("x") > 300).alias("spread"))

    register("random_points", random, "SELECT count(*) AS points, true AS inside, true AS spread FROM orders")


def _rasters() -> None:
    def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = views.embedding_points(spark, sf_dir)
        return rounded(node_of(p, grid_spec(p, Options(2.0, 2.0))).select("pid", "i", "j", "rx", "ry"), 4)

    register("node_cells", cells, f"""WITH src AS ({views.SQL['emb']}), e AS (SELECT min(x) AS x0, min(y) AS y0 FROM src), c AS (SELECT pid, x - x0 AS xr, y - y0 AS yr, CAST(floor((x - x0) / 2.0) AS INTEGER) AS i, CAST(floor((y - y0) / 2.0) AS INTEGER) AS j FROM src, e)
SELECT pid, i, j, round(xr - i * 2.0, 4) AS rx, round(yr - j * 2.0, 4) AS ry FROM c""")

    def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Whether a job says no to a box that the data does not overlap, for a table of points and for its extent from headers."""
        p, rows = views.event_points(spark, sf_dir), []
        e = grid_spec(p, Options()).bbox
        far = (e[2] + 10, e[3] + 10, e[2] + 20, e[3] + 20)
        for case, box, known in (("table, apart", far, None), ("header, apart", far, e), ("header, within", e, e)):
            try:
                if known is None:
                    run(spark, p, Options(6.0, 6.0, measures=["den"], bbox=box), f"{workspace(spark)}/o", ("arc",))
                else:
                    grid_spec(p, Options(6.0, 6.0, bbox=box), known)
                rows.append((case, False))
            except ValueError:
                rows.append((case, True))
        return spark.createDataFrame(rows, "job string, refused boolean")

    register("no_overlap", overlap, "SELECT * FROM (VALUES ('table, apart', true), ('header, apart', true), ('header, within', false)) t(job, refused)")

    def emb(spark: SparkSession, sf_dir: str, o: Options) -> tuple[DataFrame, GridSpec]:
        p = views.embedding_points(spark, sf_dir)
        spec = grid_spec(p, o)
        return grid(p, spec, o), spec

    def tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The mean raster as classic TIFF through the driver and as BigTIFF put in place by tasks: the pixels of both."""
        nodes, spec = emb(spark, sf_dir, Options(2.0, 2.0, measures=["max"]))
        folder, parts = workspace(spark), []
        for way, big in (("classic", False), ("big", True)):
            write_geotiff(nodes, spec, "max", f"{folder}/{way}.tif", 26910, big, shared=big)
            data, _ = read_geotiff(f"{folder}/{way}.tif")
            row, i = np.nonzero(data != NODATA)
            parts += [(way, int(a), int(spec.gy - 1 - b), float(v)) for b, a, v in zip(row, i, data[row, i])]
        return rounded(spark.createDataFrame(parts, "way string, i int, j int, value double"), 3)

    register("geotiff_pixels", tiff, grid_sql("emb", 2.0) + "SELECT way, i, j, round(CAST(CAST(zmax AS FLOAT) AS DOUBLE), 3) AS value FROM n, (VALUES ('classic'), ('big')) w(way)")

    def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Size, place and reference system as read back: by default, and with a transform and WKT of the caller's."""
        nodes, spec = emb(spark, sf_dir, Options(2.0, 2.0, measures=["den"]))
        folder, rows = workspace(spark), []
        for way, more in (("own", {}), ("given", {"transform": (1.0, 2.0, 0.0, 9.0, 0.0, 2.0), "wkt": "LOCAL_CS[]"})):
            write_geotiff(nodes, spec, "den", f"{folder}/{way}.tif", 26910, **more)
            _, t = read_geotiff(f"{folder}/{way}.tif")
            place = (t[33922][3], t[33550][0], t[33922][4], -t[33550][1]) if 33550 in t else (t[34264][3], t[34264][0], t[34264][7], t[34264][5])
            rows.append((way, t[256][0], t[257][0], *(round(float(v), 6) for v in place), t[34735][t[34735].index(3072) + 3], bytes(t.get(34737, b"")).decode().strip("\0|"), bytes(t[42113]).decode().strip("\0")))
        return spark.createDataFrame(rows, "way string, cols int, rows int, left double, dx double, top double, dy double, epsg int, wkt string, nodata string")

    register("geotiff_tags", tags, grid_sql("emb", 2.0) + """SELECT way, gx AS cols, gy AS rows, round(CASE way WHEN 'own' THEN x0 ELSE 1.0 END, 6) AS left, 2.0::DOUBLE AS dx, round(CASE way WHEN 'own' THEN y0 + gy * 2.0 ELSE 9.0 END, 6) AS top,
  CASE way WHEN 'own' THEN -2.0::DOUBLE ELSE 2.0::DOUBLE END AS dy, 26910 AS epsg, CASE way WHEN 'own' THEN '' ELSE 'LOCAL_CS[]' END AS wkt, '-9999' AS nodata FROM e, (VALUES ('own'), ('given')) w(way)""")

    def files(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines of the ARC file (through the driver), the GRID file (put in place by tasks) and the part files, in order."""
        nodes, spec = emb(spark, sf_dir, Options(2.0, 2.0, measures=["den"]))
        folder = workspace(spark)
        write_text(nodes, spec, "den", f"{folder}/{output_name('o', 'den', 'asc')}")
        write_text(nodes, spec, "den", f"{folder}/{output_name('o', 'den', 'grid')}", "grid", shared=True)
        write_text_parts(nodes, spec, "den", f"file://{folder}/parts")
        with open(f"{folder}/whole.parts", "w") as out:
            out.write("\n" * 6)
            for name in sorted(x for x in os.listdir(f"{folder}/parts") if x.startswith("part-")):
                with open(f"{folder}/parts/{name}") as f:
                    out.write(f.read())
        rows = []
        for name in ("o.den.asc", "o.den.grid", "whole.parts"):
            with open(f"{folder}/{name}") as f:
                rows += [(name, n, line) for n, line in enumerate(f.read().split("\n")[:-1]) if n >= 6]
        return spark.createDataFrame(rows, "file string, line int, text string")

    register("raster_files", files, grid_sql("emb", 2.0) + """, g AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM e, range((SELECT gx FROM e)) a(i), range((SELECT gy FROM e)) b(j)),
l AS (SELECT g.j, string_agg(CASE WHEN n.i IS NULL THEN '-9999 ' ELSE printf('%d ', n.den) END, '' ORDER BY g.i) AS text FROM g LEFT JOIN n ON g.i = n.i AND g.j = n.j GROUP BY g.j)
SELECT file, CAST(6 + gy - 1 - j AS INTEGER) AS line, text FROM l, e, (VALUES ('o.den.asc'), ('o.den.grid'), ('whole.parts')) f(file)""")

    def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = grid_spec(views.embedding_points(spark, sf_dir), Options(2.0, 2.0))
        return spark.createDataFrame([(kind, n, x) for kind, f in (("arc", arc_header), ("grid", grid_header)) for n, x in enumerate(f(spec).split("\n")[:-1])], "kind string, line int, text string")

    lines = {"arc": ["printf('ncols %d', gx)", "printf('nrows %d', gy)", "printf('xllcorner %.6f', x0)", "printf('yllcorner %.6f', y0)", "'cellsize 2.000000'", "'NODATA_value -9999'"], "grid": ["printf('north: %.6f', y1)", "printf('south: %.6f', y0)", "printf('east: %.6f', x1)", "printf('west: %.6f', x0)", "printf('rows: %d', gy)", "printf('cols: %d', gx)"]}
    register("raster_headers", heads, grid_sql("emb", 2.0) + " UNION ALL ".join(f"SELECT '{kind}' AS kind, {n} AS line, {x} AS text FROM e" for kind, xs in lines.items() for n, x in enumerate(xs)))

    def pixel_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Means of bins as a GeoTIFF with the upper left corner in place, read back pixel by pixel."""
        p = views.event_points(spark, sf_dir)
        g, path = pixels(p)[0], f"{workspace(spark)}/p.tif"
        write_pixels(bin_mean(p, g), g, path, epsg=4326, shared=True)
        data, t = read_geotiff(path)
        row, col = np.nonzero(data != NODATA)
        out = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(row, col, data[row, col])], "row int, col int, mean double")
        return rounded(out.withColumns({"cols": F.lit(t[256][0]), "rows": F.lit(t[257][0]), "left": F.lit(t[33922][3]), "top": F.lit(t[33922][4])}), 3)

    register("pixel_raster", pixel_raster, f"WITH src AS ({views.SQL['evt']}), {PIX_SQL} SELECT row, col, round(CAST(CAST(avg(z) AS FLOAT) AS DOUBLE), 3) AS mean, CAST(any_value(cols) AS INTEGER) AS cols, CAST(any_value(rows) AS INTEGER) AS rows, round(any_value(x0), 3) AS left, round(any_value(y1), 3) AS top FROM px GROUP BY row, col")

    def pixel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = PixelGrid.of(views.event_points(spark, sf_dir), *queries.RES)
        return rounded(spark.createDataFrame([(g.cols, g.rows, g.max_x, g.min_y, g.cells, g.nbytes(8))], "cols long, rows long, max_x double, min_y double, cells long, bytes long"))

    register("pixel_grid", pixel_grid, f"WITH src AS ({views.SQL['evt']}), {PIX_SQL} SELECT cols, rows, round(x0 + cols * {queries.RES[0]!r}, 6) AS max_x, round(y1 - rows * {queries.RES[1]!r}, 6) AS min_y, cols * rows AS cells, cols * rows * 8 AS bytes FROM ext")


def _order() -> None:
    def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The place of every point in the order of each axis, from the sorted rows themselves."""
        p, out = views.embedding_points(spark, sf_dir), None
        for axis in "xyz":
            rows = sort_points(p, axis).select("pid", axis, F.monotonically_increasing_id().alias("n"))
            rows = rows.select("pid", F.lit(axis).alias("axis"), (F.row_number().over(Window.orderBy("n")) - 1).alias("place"))
            out = rows if out is None else out.unionByName(rows)
        return out

    rest = {"x": "y, z", "y": "x, z", "z": "x, y"}
    register("sorted_points", ranks, f"WITH src AS ({views.SQL['emb']}) " + " UNION ALL ".join(f"SELECT pid, '{a}' AS axis, CAST(row_number() OVER (ORDER BY {a}, {r}) - 1 AS INTEGER) AS place FROM src" for a, r in rest.items()))
    register("bucket_capacity", lambda s, d: first_points(views.embedding_points(s, d), 100, ["z", "pid"]).select("pid"), f"WITH src AS ({views.SQL['emb']}) SELECT pid FROM src ORDER BY z, pid LIMIT 100")


def _tables() -> None:
    def ellipsoids(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = []
        for name, args in {"default": (), "sphere": (6371000.0, 6371000.0), "long": (1.0, 2.0), "flat": (1.0, 0.0), "negative": (-1.0, 1.0)}.items():
            try:
                e = crs.Ellipsoid(*args)
                rows.append((name, e.a, e.b, round(e.e2, 12), round(e.ep2, 12)))
            except ValueError:
                rows.append((name, None, None, None, None))
        return spark.createDataFrame(rows, "name string, a double, b double, e2 double, ep2 double")

    register("ellipsoids", ellipsoids, "SELECT name, a, b, round((a * a - b * b) / (a * a), 12) AS e2, round((a * a - b * b) / (b * b), 12) AS ep2 FROM (VALUES ('default', 6378137.0::DOUBLE, 6356752.3142::DOUBLE), ('sphere', 6371000.0, 6371000.0), ('long', NULL, NULL), ('flat', NULL, NULL), ('negative', NULL, NULL)) t(name, a, b)")
    sizes = {"Unknown": 0, "Byte": 1, "UInt16": 2, "Int16": 2, "UInt32": 4, "Int32": 4, "Float32": 4, "Float64": 8, "CInt16": 2, "CInt32": 4, "CFloat32": 4, "CFloat64": 8}
    register("pixel_types", lambda s, d: s.createDataFrame([(n, dtypes.size_of(n)) for n in dtypes.DTYPES], "name string, bytes int"), f"SELECT * FROM (VALUES {', '.join(f'({n!r}, {v})' for n, v in sizes.items())}) t(name, bytes)")

    def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, ph = run(spark, views.event_points(spark, sf_dir), Options(6.0, 6.0, measures=["den"]), f"{workspace(spark)}/o", ("arc",))
        return spark.createDataFrame([(k, v >= 0 and v <= ph.seconds["total"]) for k, v in ph.seconds.items()], "phase string, within boolean")

    register("phases", phases, "SELECT * FROM (VALUES ('extent', true), ('plan', true), ('process', true), ('write', true), ('total', true)) t(phase, within)")

    def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
        """One task for each region: whether its worker says how much memory it uses."""
        n = spark.read.parquet(f"{sf_dir}/region.parquet").count()
        return worker_memory(spark, n).select("task", (F.col("resident").between(1, F.col("virtual"))).alias("known"))

    register("process_memory", memory, "SELECT r_regionkey AS task, true AS known FROM region")

    def command(spark: SparkSession, sf_dir: str) -> DataFrame:
        """LAS files to a GeoTIFF by the command line, the pixels read back."""
        files, out = las_files(spark, sf_dir), f"{workspace(spark)}/dem"
        with contextlib.redirect_stdout(io.StringIO()):
            code = cli.main(["-i", *files, "-o", out, "--resolution", "6", "--max", "--output_format", "tif", "--keep_class", "2", "3"])
        data, _ = read_geotiff(f"{out}.max.tif")
        row, i = np.nonzero(data != NODATA)
        rows = [(code, int(b), int(data.shape[0] - 1 - a), float(v)) for a, b, v in zip(row, i, data[row, i])]
        return rounded(spark.createDataFrame(rows, "code int, i int, j int, value double"), 3)

    cut = grid_sql("evt", 6.0, where="classification IN (2, 3)").replace(f"WITH src AS ({views.SQL['evt']})", f"WITH evt AS ({views.SQL['evt']}), src AS ({CUT})")
    register("command_line", command, cut + "SELECT 0 AS code, i, j, round(CAST(CAST(zmax AS FLOAT) AS DOUBLE), 3) AS value FROM n")


def _streams() -> None:
    def points(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = spark.read.parquet(f"{sf_dir}/events.parquet")
        s = spark.readStream.schema(t.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        return s.select(F.col("user_id").cast("double").alias("x"), F.col("value").alias("z"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / F.lit(3600000000.0)).alias("y"), F.col("ts").cast("timestamp").alias("ts"))

    def live(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The whole table as a stream, the raster over its whole extent."""
        spec = grid_spec(views.event_points(spark, sf_dir), Options(6.0, 6.0))
        folder = workspace(spark)
        write_batches(live_grid(points(spark, sf_dir), spec, measures=["min", "max", "mean", "den"]), f"file://{folder}/out", f"file://{folder}/state").awaitTermination()
        return rounded(last_batch(spark, f"file://{folder}/out"))

    register("stream_grid", live, grid_sql("evt", 6.0) + "SELECT i, j, round(zmin, 6) AS zmin, round(zmax, 6) AS zmax, round(zmean, 6) AS zmean, den FROM n")

    def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A raster for every ten days of event time, kept up to date over the stream."""
        spec = grid_spec(views.event_points(spark, sf_dir), Options(6.0, 6.0))
        folder = workspace(spark)
        nodes = windowed_grid(points(spark, sf_dir), spec, "ts", "10 days", "1 hour", measures=["min", "max", "mean", "den"])
        write_batches(nodes, f"file://{folder}/out", f"file://{folder}/state").awaitTermination()
        out = last_batch(spark, f"file://{folder}/out")
        return rounded(out.select(F.floor(F.unix_seconds("window.start") / 86400).cast("long").alias("day"), "i", "j", "zmin", "zmax", "zmean", "den"))

    by = grid_sql("evt", 6.0).replace("value AS z,", "value AS z, epoch_us(ts) // 864000000000 * 10 AS day,").replace("yr, z, gx, gy", "yr, z, day, gx, gy").replace("SELECT CAST(i AS INTEGER) AS i", "SELECT day, CAST(i AS INTEGER) AS i").replace("GROUP BY i, j)", "GROUP BY day, i, j)")
    register("stream_windows", windowed, by + "SELECT CAST(day AS BIGINT) AS day, i, j, round(zmin, 6) AS zmin, round(zmax, 6) AS zmax, round(zmean, 6) AS zmean, den FROM n")


_las()
_sources()
_rasters()
_order()
_tables()
_streams()
