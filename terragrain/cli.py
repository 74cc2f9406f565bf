"""Command line: point files to rasters.

    python -m terragrain.cli -i a.las b.las -o out --resolution 1 --mean --output_format tif
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.job import Options, run
from .sources import expand_paths, las_headers, read_ascii, read_file_list, read_las, read_polygons
from .spec import DEFAULT_RESOLUTION, MEASURES, float32

FORMATS = {"all": ("arc", "grid", "tif"), "arc": ("arc",), "grid": ("grid",), "tif": ("tif",)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terragrain", description="Grid point clouds.")
    p.add_argument("-o", "--output_file_name", required=True, help="prefix of output files")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("-i", "--data_file_name", nargs="+", help="input files; wildcards and ${VARIABLES} are expanded")
    source.add_argument("-f", "--input_data_file_name", help="a file that lists input files, one a line")
    p.add_argument("--input_format", choices=("las", "ascii"), default="las")
    p.add_argument("-r", "--search_radius", type=float, help="default: sqrt(2) * resolution in x")
    p.add_argument("--output_format", choices=tuple(FORMATS), default="all")
    p.add_argument("--output_bbox", nargs=4, type=float, metavar=("MIN_X", "MIN_Y", "MAX_X", "MAX_Y"))
    p.add_argument("--output_shape", help="polygon shapefile; replaces --output_bbox")
    p.add_argument("-m", "--interpolation_mode", choices=("auto", "incore", "outcore", "parallel"), default="auto", help="accepted; Spark runs one plan at every size, incore keeps that mode's weights for idw")
    p.add_argument("-c", "--reader_count", type=int, default=0, help="least number of scan tasks for a single file")
    p.add_argument("-b", "--buffer_size", type=int, default=10_000, help="accepted; Spark sizes its own buffers")
    p.add_argument("-t", "--mpi_times", action="store_true", help="print seconds by phase")
    p.add_argument("--keep_class", nargs="+", type=int)
    p.add_argument("--first_returns", action="store_true")
    p.add_argument("--last_returns", action="store_true")
    for m in (*MEASURES, "all"):
        p.add_argument(f"--{m}", action="store_true", dest=f"measure_{m}")
    p.add_argument("--epsg", type=int, default=0)
    p.add_argument("--bigtiff", type=int, default=1)
    p.add_argument("--resolution", type=float)
    p.add_argument("--resolution-x", type=float)
    p.add_argument("--resolution-y", type=float)
    p.add_argument("--fill", action="store_true")
    p.add_argument("--fill_window_size", "--fill_window", type=int, choices=(3, 5, 7))
    p.add_argument("--fill_empty", action="store_true")
    p.add_argument("--strict", action="store_true", help="single-precision parameters and overwriting row fill")
    return p


def options(a: argparse.Namespace) -> Options:
    single = float32 if a.strict else float
    rx = a.resolution_x or a.resolution or DEFAULT_RESOLUTION
    ry = a.resolution_y or a.resolution or DEFAULT_RESOLUTION
    for v in (a.resolution, a.resolution_x, a.resolution_y):
        if v is not None and v <= 0:
            raise SystemExit("resolution must be positive")
    if a.epsg < 0:
        raise SystemExit("EPSG codes are positive")
    measures = [] if a.measure_all else [m for m in MEASURES if getattr(a, f"measure_{m}")]
    return Options(
        resolution_x=single(rx), resolution_y=single(ry), radius=None if a.search_radius is None else single(a.search_radius), measures=measures,
        bbox=tuple(a.output_bbox) if a.output_bbox else None, shape=read_polygons(a.output_shape) if a.output_shape else None, classes=a.keep_class,
        first_returns=a.first_returns, last_returns=a.last_returns, window=(a.fill_window_size or 3) if (a.fill or a.fill_window_size) else 0,
        fill_empty=a.fill_empty, strict_fill=a.strict, legacy_idw=a.interpolation_mode == "incore" and a.strict, epsg=a.epsg, bigtiff=bool(a.bigtiff),
    )


def points_of(spark: SparkSession, a: argparse.Namespace, o: Options) -> tuple[DataFrame, tuple[float, float, float, float] | None]:
    """The points and, for LAS, their extent from the headers."""
    paths = expand_paths(a.data_file_name) if a.data_file_name else read_file_list(a.input_data_file_name)
    if a.input_format == "ascii":
        return read_ascii(spark, paths), None
    e = las_headers(spark, paths).agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y"), F.sum("points")).first()
    columns = ["x", "y", "z"] + (["classification"] if o.classes else []) + (["return_number"] if o.first_returns or o.last_returns else []) + (["return_count"] if o.last_returns else [])
    per = max(1, -(-int(e[4] or 1) // a.reader_count)) if a.reader_count else 4_000_000
    return read_las(spark, paths, columns, o.bbox, points_per_task=per), tuple(e)[:4]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    o = options(a)
    spark = SparkSession.builder.appName("terragrain").getOrCreate()
    points, extent = points_of(spark, a, o)
    files, phases = run(spark, points, o, a.output_file_name, FORMATS[a.output_format], extent)
    for f in files:
        print(f)
    if a.mpi_times:
        for name, s in phases.seconds.items():
            print(f"{name}: {s:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
