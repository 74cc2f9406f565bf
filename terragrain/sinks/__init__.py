"""Raster and bucket writers."""

from .geotiff import read_geotiff, write_geotiff
from .pixels import write_pixels
from .text import arc_header, grid_header, raster_lines, write_text

__all__ = ["arc_header", "grid_header", "raster_lines", "read_geotiff", "write_geotiff", "write_pixels", "write_text"]
