"""Predicates over points and files; all of them are plain column expressions that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BBox = tuple[float, float, float, float]


def in_bbox(bbox: BBox, x: str | Column = "x", y: str | Column = "y") -> Column:
    """Closed on all sides."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return x.between(bbox[0], bbox[2]) & y.between(bbox[1], bbox[3])


def overlaps_open(a: BBox, b: BBox) -> bool:
    """Rectangles share an area; touching is not enough."""
    return a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]


def header_overlaps(bbox: BBox) -> Column:
    """The same over columns min_x, min_y, max_x, max_y of a table of file headers."""
    return (F.col("min_x") < bbox[2]) & (F.col("max_x") > bbox[0]) & (F.col("min_y") < bbox[3]) & (F.col("max_y") > bbox[1])


def overlaps_closed(ax0: Column, ay0: Column, ax1: Column, ay1: Column, b: BBox) -> Column:
    """Rectangles share at least a point in x and y; touching is enough."""
    return (ax0 <= b[2]) & (ax1 >= b[0]) & (ay0 <= b[3]) & (ay1 >= b[1])


def keep_points(classes: list[int] | None = None, first_returns: bool = False, last_returns: bool = False) -> Column | None:
    """Attribute filters are alternatives: class in the list, OR a first return, OR a last return. None if there is no filter."""
    parts = []
    if classes:
        parts.append(F.col("classification").isin(*classes))
    if first_returns:
        parts.append(F.col("return_number") == 1)
    if last_returns:
        parts.append(F.col("return_number") == F.col("return_count"))
    out = None
    for p in parts:
        out = p if out is None else out | p
    return out


def prune_files(headers: DataFrame, bbox: BBox) -> DataFrame:
    """Headers of the files that can hold points of ``bbox``."""
    return headers.where(header_overlaps(bbox))


def require_overlap(extent: BBox, bbox: BBox) -> None:
    if not overlaps_open(extent, bbox):
        raise ValueError(f"bbox {bbox} does not overlap the data, which spans {extent}")
