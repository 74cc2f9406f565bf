"""Readers: LAS, delimited text, shapefiles, bucket files, lists of files."""

from .ascii import read_ascii
from .bucket import read_buckets
from .filelist import expand_paths, list_files, read_file_list
from .las import las_headers, read_las
from .shp import read_polygons

__all__ = ["expand_paths", "las_headers", "list_files", "read_ascii", "read_buckets", "read_file_list", "read_las", "read_polygons"]
