"""Rasters of plain bins: the mean of each pixel, from the upper left corner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bins import PixelGrid
from ..spec import GridSpec
from .geotiff import write_geotiff
from .text import write_text


def as_nodes(bins: DataFrame, grid: PixelGrid) -> tuple[DataFrame, GridSpec]:
    """The bins (row, col, mean) as nodes of a lattice with one node for each pixel, rows counted from below."""
    far = lambda low, n, res: max(low, low + (n - 1 - 1e-9) * res)  # noqa: E731  rounding must not add a node
    spec = GridSpec(grid.ox, grid.min_y, far(grid.ox, grid.cols, grid.res_x), far(grid.min_y, grid.rows, grid.res_y), grid.res_x, grid.res_y)
    return bins.select(F.col("col").alias("i"), (F.lit(grid.rows - 1) - F.col("row")).alias("j"), F.col("mean").alias("zmean")), spec


def write_pixels(bins: DataFrame, grid: PixelGrid, path: str, kind: str = "tif", epsg: int = 0, big: bool = True, shared: bool = False) -> None:
    """One file of the means, "no data" where a pixel has no point: kind tif (Float32, placed by the upper left corner), arc or grid."""
    nodes, spec = as_nodes(bins, grid)
    if kind == "tif":
        write_geotiff(nodes, spec, "mean", path, epsg, big, transform=(grid.ox, grid.res_x, 0.0, grid.oy, 0.0, -grid.res_y), shared=shared)
    else:
        write_text(nodes, spec, "mean", path, kind, shared)
